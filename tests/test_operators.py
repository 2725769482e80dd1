"""Edge cases of the operators that queries don't reach."""

import math

import pytest
from pyspark.sql import functions as F

from tessaly.functions.crosssection import Cross
from tessaly.functions.timeseries import Rolling, ewm
from tessaly.operators import bars, derived, joins, replay
from tessaly.operators.backtest import return_metrics
from tessaly.operators.neutralize import residualise
from tessaly.plans import registry, research_queries
from tessaly.plans.panel import densify
from tessaly.sources import storage
from tessaly.streaming.bars import windowed_bars


def _series(spark, values, code="A"):
    return spark.createDataFrame([(i, code, v) for i, v in enumerate(values)], "trade_date int, ts_code string, x double")


def _values(frame, column):
    return [r[0] for r in frame.orderBy("trade_date").select(column).collect()]


def test_frames_count_values_not_slots(spark):
    frame = _series(spark, [1.0, None, 3.0, float("nan"), 5.0])
    r = Rolling(3, 2)
    assert _values(frame.select("trade_date", r.sum(F.col("x")).alias("v")), "v") == [None, None, 4.0, None, 8.0]
    assert _values(frame.select("trade_date", Rolling(2, 3).sum(F.col("x")).alias("v")), "v") == [None] * 5
    assert _values(frame.select("trade_date", Rolling(3, 1).argmax(F.col("x")).alias("v")), "v") == [0.0, 0.0, 2.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        Rolling(0, 1)


def test_constant_series_have_no_shape(spark):
    frame = _series(spark, [2.0] * 4)
    r = Rolling(4, 2)
    got = frame.select("trade_date", r.skew(F.col("x")).alias("a"), r.zscore(F.col("x")).alias("b"), r.corr(F.col("x"), F.col("x")).alias("c"), r.minmax_scale(F.col("x")).alias("d"), r.ir(F.col("x")).alias("e"))
    assert all(v is None for row in got.drop("trade_date").collect() for v in row)


def test_infinite_mean_skips_gaps(spark):
    got = _values(ewm(_series(spark, [1.0, None, 2.0, 3.0]), "x", 3, 2), "ewm")
    assert got == [None, None, 1.5, 2.25]


def test_ordinal_ranks_follow_the_code(spark):
    frame = spark.createDataFrame([(1, "B", 2.0, ""), (1, "A", 2.0, None), (1, "C", 1.0, "g"), (1, "D", None, "g")], "trade_date int, ts_code string, x double, grp string")
    d = Cross()
    got = {r.ts_code: (r.up, r.down, r.f) for r in frame.select("ts_code", d.rank(F.col("x")).alias("up"), d.rank(F.col("x"), False).alias("down"), d.by("grp").fill_mean(F.col("x")).alias("f")).collect()}
    assert got == {"C": (1.0, 3.0, 1.0), "A": (2.0, 1.0, 2.0), "B": (3.0, 2.0, 2.0), "D": (None, None, 1.0)}


def test_groups_are_not_tiles(spark):
    frame = spark.createDataFrame([(1, f"c{k}", float(k)) for k in range(8)], "trade_date int, ts_code string, x double")
    sizes = [r["count"] for r in frame.select(Cross().groups(F.col("x"), 5).alias("g")).groupBy("g").count().orderBy("g").collect()]
    assert sizes == [2, 2, 1, 2, 1]


def test_singular_regressions_are_missing(spark):
    frame = spark.createDataFrame([(1, f"c{k}", float(k), 1.0, 2.0) for k in range(6)], "trade_date int, ts_code string, y double, a double, b double")
    assert {r.residual for r in residualise(frame, "y", ["a", "b"]).collect()} == {None}


def test_bars_of_a_session(spark):
    rows = [(1, "A", t, 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 10.0, 20.0) for k, t in enumerate(["09:31", "2026-01-05 09:32:00", "13:01", "12:00", "15:00"])] + [(1, "A", "09:33", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    out = bars.minute_bars(spark.createDataFrame(rows, "trade_date int, ts_code string, trade_time string, open double, high double, low double, close double, vol double, amount double"), 120).orderBy("bar_index").collect()
    assert [(r.bar_index, r.open, r.close, r.minute_count, r.vwap) for r in out] == [(0, 1.0, 2.5, 2, 2.0), (1, 3.0, 5.5, 2, 2.0)]
    with pytest.raises(ValueError):
        bars.minute_bars(spark.range(1), 7)


def test_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, d int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 9, "z")], "k string, s int, v string")
    got = {(r.k, r.d): r.v for r in joins.asof_join(left, right, ["k"], "d", "s", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 5): None}


def test_main_contract_needs_a_tenth_more(spark):
    rows = [("P", 1, 1, 100.0), ("P", 1, 2, 100.0), ("P", 2, 1, 100.0), ("P", 2, 2, 109.0), ("P", 3, 1, 100.0), ("P", 3, 2, 110.0), ("P", 4, 1, 900.0), ("P", 4, 2, 1.0), ("P", 5, 1, 9.0), ("P", 6, 1, 9.0), ("P", 6, 4, 2.0), ("P", 6, 3, 2.0)]
    out = derived.main_contract(spark.createDataFrame(rows, "p string, d int, m int, oi double"), "p", "d", "m", "oi").orderBy("d").collect()
    # an earlier contract never takes over: without the main one a date has no row, or a later one
    assert [(r.d, r.main) for r in out] == [(1, 1), (2, 1), (3, 2), (4, 2), (6, 3)]


def test_metrics_of_a_short_series(spark):
    r = return_metrics(spark.createDataFrame([(1, 0.1), (2, -0.5), (3, 0.2), (4, None)], "trade_date int, ret double")).first()
    assert (r.n, round(r.cumulative, 6), round(r.max_drawdown, 6), round(r.win_rate, 6), r.sortino) == (3, -0.34, -0.5, 0.666667, None)


def test_fills_and_distributions():
    free = replay.Costs(0, 0, 0, 100)
    assert replay.fill(10_000.0, 0, 950, 10.0, free) == (1000.0, 900, 900)
    assert replay.fill(0.0, 950, 0, 10.0, free) == (9500.0, 0, -950)
    assert replay.fill(1e6, 0, 100, 10.0, free, limit_up=True)[2] == 0 and replay.fill(0.0, 100, 0, 10.0, free, limit_down=True)[2] == 0
    assert replay.distribute(1000, 0.5, 1.0) == (1500, 1000.0)
    shares, cash = replay.distribute(1900, 0.3, 0.045)
    assert shares == 2470 and math.isclose(cash, 85.5)


def test_replay_goes_long_above_the_mean(spark):
    frame = spark.createDataFrame([("r", k, float(p), float(p)) for k, p in enumerate([10, 10, 11, 12, 9, 8])], "run string, d int, o double, c double")
    out = replay.moving_average_runs(frame, "run", "d", "o", "c", 2, 10_000.0, replay.Costs(0, 0, 0, 1)).orderBy("d").collect()
    assert [r.shares for r in out] == [0, 0, 0, 833, 833, 0] and out[-1].equity == 10_000 - 833 * 12 + 833 * 8


def test_dense_panels_and_storage(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", 1.0), (2, "B", 2.0)], "trade_date int, ts_code string, x double")
    assert {(r.trade_date, r.ts_code, r.x, r.present) for r in densify(rows).collect()} == {(1, "A", 1.0, True), (1, "B", None, False), (2, "A", None, False), (2, "B", 2.0, True)}
    path = str(tmp_path / "t")
    storage.write_factors(rows, path)
    storage.write_factors(spark.createDataFrame([(2, "B", 7.0)], rows.schema), path)
    back = storage.read_table(spark, path, ["trade_date", "ts_code", "x", "nope"], start=1, end=2, codes=["A", "B"])
    assert {tuple(r) for r in back.collect()} == {(1, "A", 1.0), (2, "B", 7.0)} and dict(back.dtypes)["x"] == "float"
    with pytest.raises(ValueError):
        storage.read_table(spark, path, ["trade_time", "x"])
    with pytest.raises(ValueError):
        storage.read_table(spark, path, ["trade_date", "nope"])
    registry = storage.metadata(spark, [{"id": "a", "tags": ["t", "u"]}, {"id": "b", "tags": ["t"], "deprecated": True}])
    assert [r.id for r in storage.select_metadata(registry, ["t"]).collect()] == ["a"]


def test_stream_bars_equal_table_bars(spark, tmp_path):
    rows = spark.sql("select timestamp'2026-01-05 09:00:00' + make_interval(0,0,0,0,0,id,0) as ts, concat('k', id % 2) as k, double(id % 7) as v from range(200)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "k", "v", "30 minutes", "10 minutes")
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {tuple(r) for r in windowed_bars(rows, "ts", "k", "v", "30 minutes", "10 minutes").collect()}
    assert {tuple(r) for r in spark.table("bars_out").collect()} == want


def test_registered_factors_cover_all_dates_unless_asked(spark):
    rows = [(d, "a", d != 19961130, float(d % 97), float(d % 89)) for y in (1995, 1996, 1997) for d in (y * 10000 + m * 100 + 30 for m in range(1, 13))]
    panel = spark.createDataFrame(rows, "trade_date int, ts_code string, present boolean, turnover double, close double")
    specs = registry.select(["momentum_3", "turnover_6", "price_place_12"])
    whole = {r.trade_date: r for r in registry.compute(panel, specs).collect()}
    assert set(whole) == {r[0] for r in rows} - {19961130}
    part = {r.trade_date: r for r in registry.compute(panel, specs, 19960301, 19970228).collect()}
    assert part == {d: r for d, r in whole.items() if 19960301 <= d <= 19970228}
    assert any(d // 10000 != 1996 for d in {r.trade_date for r in research_queries.QUERIES["factor_library"](spark, "/root/testdata/sf0.001").collect()})
