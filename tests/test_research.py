"""Hand-made and brute-force cases of kernels, replay, datasets, models, networks and sessions."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaly.__main__ import main
from tessaly.functions import kernels, transforms
from tessaly.operators import derived, evaluation, futures, joins, networks, replay, sessions
from tessaly.operators.exposures import composite, weighted_zscore
from tessaly.plans import futures_queries, models, registry
from tessaly.sources.datasets import Catalogue, Dataset, paired

NAN = float("nan")


def test_runs_equal_all_orders():
    x = np.array([1.0, -1.0, NAN, 2.0, 3.0, -1.0, -2.0])
    places = np.flatnonzero(~np.isnan(x))
    edges = [(a, b) for a, b in zip(places[:-1], places[1:], strict=True) if b == a + 1]
    signs = (x[places] >= 0).tolist()
    counts = []
    for order in itertools.permutations(signs):
        at = dict(zip(places.tolist(), order, strict=True))
        counts.append(sum(at[int(a)] != at[int(b)] for a, b in edges))
    own = dict(zip(places.tolist(), signs, strict=True))
    switches = sum(own[int(a)] != own[int(b)] for a, b in edges)
    want = math.tanh((np.mean(counts) - switches) / (2 * np.std(counts)))
    assert kernels.runs_score(x) == pytest.approx(want)
    assert kernels.runs_score(np.ones(6)) == 0.0 and math.isnan(kernels.runs_score(np.array([1.0, NAN, 1.0, NAN, -1.0, NAN, 1.0])))


def test_expected_range_and_memory():
    rng = np.random.default_rng(0)
    sampled = np.mean([kernels.rescaled_range(r) for r in rng.normal(size=(40_000, 8))])
    assert kernels.expected_range(8) == pytest.approx(sampled, rel=0.01)
    free = np.mean([kernels.long_memory(r) for r in rng.normal(size=(300, 64))])
    trend = kernels.long_memory(np.concatenate([np.ones(32), -np.ones(32)]) + rng.normal(0, 0.3, 64))
    assert abs(free) < 0.15 and trend > free and math.isnan(kernels.long_memory(np.full(64, NAN)))


def test_ljung_box_with_gaps():
    x = np.array([1.0, 2.0, NAN, 1.5, 3.0, 2.5, 0.5, 2.0, 1.0, 3.5])
    c = x - np.nanmean(x)
    want, signed = 0.0, 0.0
    for k in range(1, 4):
        products = [c[i] * c[i - k] for i in range(k, 10) if not math.isnan(c[i] * c[i - k])]
        rho = sum(products) / np.nansum(c * c)
        want += 9 * 11 * rho**2 / len(products)
        signed += math.copysign(9 * 11 * rho**2 / len(products), rho)
    energy, score = kernels.ljung_box(x, 3)
    assert energy == pytest.approx(want)
    assert score == pytest.approx((energy - 3) / (energy + 3) * signed / energy if energy > 3 else 0.0)


def test_distributions_keep_value():
    account = replay.Account(20_000.0)
    account.marks["A"] = 10.0
    assert account.trade("A", 1000, 10.0, replay.Costs(0, 0, 0, 1)) == (1000, 0.0)
    account.go_ex("A", 1000, 0.5, 1.0, 20200108, 20200109)
    assert (account.shares("A"), account.held["A"], account.receivable) == (1500, 1000, [(20200108, 1000.0)])
    assert account.equity() == pytest.approx(20_000.0)
    assert account.trade("A", 0, 6.0, replay.Costs(0, 0, 0, 1)) == (-1000, -4000.0)
    account.settle(20200108)
    assert account.cash == 17_000.0 and account.held["A"] == 0
    account.settle(20200109)
    assert account.held["A"] == 500


def _session(day, symbol, price, score=1.0, **more):
    return {"run": "r", "trade_date": day, "symbol": symbol, "open": price, "close": price, "score": score, "limit_up": False, "limit_down": False, "stock_rate": 0.0, "cash_rate": 0.0, "ex_date": 0, "pay_date": 0, "listing_date": 0, "delisted": False} | more


def test_replay_of_limits_distributions_and_delistings(spark):
    rows = [
        _session(1, "A", 10.0), _session(2, "A", 10.0, limit_up=True), _session(3, "A", 10.0, stock_rate=1.0, cash_rate=0.0, ex_date=4, pay_date=6, listing_date=6), _session(4, "A", 5.0), _session(5, "A", 5.0), _session(6, "A", 5.0, delisted=True),
    ]
    import pandas as pd

    daily, trades = replay.run_strategy(pd.DataFrame(rows), replay.top_scores(1), 10_000.0, replay.Costs(0, 0, 0, 1))
    assert [(d, n, cause) for d, _, n, _, _, cause in trades][:1] == [(3, 1000, "order")]  # the limit of day 2 blocked the first order
    assert [round(e, 6) for _, _, e, _ in daily] == [10_000.0] * 6
    assert sum(n for _, _, n, _, _, _ in trades) == 1000 - 2000 and daily[-1][3] == 0  # a distribution doubled what is sold in the end
    assert trades[-1][5] == "delisting"
    frame = spark.createDataFrame(pd.DataFrame(rows))
    assert [r.cash for r in replay.replay(frame, "run", replay.top_scores(1), 10_000.0, replay.Costs(0, 0, 0, 1)).orderBy("trade_date").collect()] == [c for _, c, _, _ in daily]
    assert replay.replay(frame, "run", replay.moving_average(2), what="trades").count() == 0


def test_contracts_close_before_they_open():
    costs = replay.Costs(0, 0, 0, 1, margin=0.1, multiplier=10)
    assert replay.trade_contracts(1000.0, 0, 0.0, 50, 100.0, costs) == (1000.0, 10, 0.0)  # the margin allows ten
    assert replay.trade_contracts(1000.0, 10, 100.0, -3, 110.0, costs) == (2000.0, -3, 1000.0)
    assert replay.trade_contracts(1000.0, -5, 100.0, -2, 120.0, costs) == (0.0, -2, -1000.0)


def test_first_in_first_out(spark):
    trades = spark.createDataFrame([("r", 1, "A", 100), ("r", 2, "A", 100), ("r", 4, "A", -150)], "run string, trade_date int, symbol string, shares long")
    days = joins.ordinals(spark.createDataFrame([(d,) for d in (1, 2, 3, 4)], "trade_date int"))
    r = replay.holding_days(trades, days, "run").first()
    assert (r.sold, r.sessions) == (150, pytest.approx((100 * 3 + 50 * 2) / 150))


def test_datasets(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path), {"pv": Dataset("pv", layout="year"), "wide": Dataset("wide", wide=True), "bt": Dataset("bt")})
    rows = spark.createDataFrame([(19991231, "A", 1.0), (20000104, "A", 2.0), (20000104, "B", 3.0)], "trade_date int, ts_code string, x double")
    assert store.missing_dates("pv", rows).count() == 2
    store.write("pv", rows)
    assert {(r.trade_date, r.ts_code, r.x) for r in store.load("pv", ["x"], 20000101, 20001231).collect()} == {(20000104, "A", 2.0), (20000104, "B", 3.0)}
    assert "PartitionFilters: [isnotnull(year" in store.load("pv", ["x"], 20000101)._jdf.queryExecution().toString()
    assert store.load_dates("pv", [19991231]).count() == 1 and store.load_dates("pv", []).count() == 0 and store.load_index("pv", "B").count() == 1
    more = spark.createDataFrame([(20000105, "A", 9.0)], rows.schema)
    assert store.complete("pv", rows.select("trade_date").union(more.select("trade_date")), lambda lost: more.unionByName(rows.filter("trade_date >= 20000000"))).count() == 4
    store.upsert("wide", rows)
    store.upsert("wide", spark.createDataFrame([(20000104, "A", None, 5.0)], "trade_date int, ts_code string, x double, y double"))
    assert {(r.trade_date, r.ts_code, r.x, r.y) for r in store.whole("wide").collect()} == {(19991231, "A", 1.0, None), (20000104, "A", None, 5.0), (20000104, "B", 3.0, None)}
    store.upsert("wide", spark.createDataFrame([(20000104, "B", 7.0)], "trade_date int, ts_code string, y double"), replace_series=True)
    assert {(r.ts_code, r.x, r.y) for r in store.load_dates("wide", [20000104]).collect()} == {("A", None, None), ("B", 3.0, 7.0)}
    store.remove_columns("wide", ["y"])
    assert "y" not in store.whole("wide").columns
    with pytest.raises(ValueError):
        store.remove_columns("wide", ["ts_code"])
    store.write_reports("bt", "f1", {"ic": rows})
    store.write_reports("bt", "f2", {"ic": rows.limit(1)})
    assert spark.read.parquet(store.path("bt") + "/ic").groupBy("factor_id").count().count() == 2
    both = paired(rows, rows.withColumn("y", F.lit(1.0)).withColumn("x", F.lit(0.0)).filter("ts_code = 'A'"))
    assert {(r.ts_code, r.x, r.y) for r in both.filter("trade_date = 20000104").collect()} == {("A", 2.0, 1.0), ("B", 3.0, None)}


def test_disclosed_statements(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path), {"fin": Dataset("fin", layout="whole")})
    store.write("fin", spark.createDataFrame([("A", 20000430, 20000331), ("A", 20000830, 20000630), ("A", 19980430, 19980331), ("A", None, 20000331)], "ts_code string, f_ann_date int, end_date int").withColumn("trade_date", F.lit(0)))
    assert [r.end_date for r in store.load_disclosed("fin", 20000601, 8).collect()] == [20000331]


def test_ridge_and_walks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    rows = [(int(i // 20), f"c{i % 20}", float(a), float(b), float(3 + 2 * a - b)) for i, (a, b) in enumerate(x)] + [(3, "n", None, 1.0, 1.0), (3, "m", float("nan"), 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "trade_date int, ts_code string, a double, b double, y double")
    m = models.Ridge(["a", "b"], "y", 0.0).fit(frame)
    assert m.weights == pytest.approx([3, 2, -1]) and models.Ridge.load(m.dump()) == models.Ridge(**json.loads(m.dump()))
    scored = models.walk_forward(frame, lambda: models.Ridge(["a", "b"], "y", 0.0), list(range(10)), 4, 2)
    assert sorted({r.trade_date for r in scored.collect()}) == [5, 6, 7, 8, 9]
    assert all(r.score == pytest.approx(r.y) for r in scored.collect())
    with pytest.raises(ValueError):
        models.Ridge(["a"], "y").predict(frame)

    @models.provider("test_a")
    def _a(spark):
        return frame.select("trade_date", "ts_code", "a")

    @models.provider("test_b")
    def _b(spark):
        return frame.select("trade_date", "ts_code", "b").filter("trade_date > 3")

    assert models.load_features(spark, ["test_a", "test_b"]).count() == 202


def test_registry_selection():
    assert [s.id for s in registry.select(["pure_momentum_6"])] == ["momentum_6_neutral"]
    assert {"price", "neutral"} <= set(registry.select(tags=["price", "neutral"])[0].tags)
    with pytest.raises(KeyError):
        registry.select(["nope"])
    assert len(registry.LABELS) == 18 and len(registry.FACTORS) >= 30


def test_command_line(capsys):
    assert main(["factors", "--tag", "neutral"]) == 0 and "momentum_6_neutral" in capsys.readouterr().out
    assert main(["transforms"]) == 0 and main(["run", "nope", "--tables", "x"]) == 2


def test_transforms_of_edges(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 1.0), (1, "b", 1.0, float("inf")), (1, "c", None, None), (2, "a", float("inf"), 2.0)], "trade_date int, ts_code string, f double, l double")
    got = {(r.trade_date, r.ts_code): (r.f, r.l) for r in transforms.apply(rows, "zscore", ["f"], ["l", "absent"], fill=-1.0).collect()}
    assert got == {(1, "a"): (0.0, 0.0), (1, "b"): (0.0, None), (1, "c"): (-1.0, None), (2, "a"): (-1.0, 0.0)}
    with pytest.raises(KeyError):
        transforms.apply(rows, "nope", ["f"])


def test_repeated_keys_are_errors(spark):
    one = spark.createDataFrame([(1, "a", 1.0)], "trade_date int, ts_code string, x double")
    assert sessions.features_with_labels(one, one.withColumnRenamed("x", "y"), ["trade_date", "ts_code"], "inner").count() == 1
    with pytest.raises(Exception, match="repeat a key"):
        sessions.features_with_labels(one.union(one), one.withColumnRenamed("x", "y"), ["trade_date", "ts_code"]).collect()


def test_asof_spans_agree(spark):
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(f"k{int(k)}", int(d), i) for i, (k, d) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 500, 200), strict=True))], "k string, d int, i int")
    right = spark.createDataFrame([(f"k{int(k)}", int(d), float(i)) for i, (k, d) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 500, 60), strict=True))], "k string, s int, v double")
    plain, cut = (sorted((r.i, r.s, r.v) if r.s is not None else (r.i, -1, -1.0) for r in joins.asof_join(left, right, ["k"], "d", "s", ["s", "v"], width=w).collect()) for w in (None, 37))
    assert plain == cut


def test_blocks_count_all_pairs(spark):
    pairs = spark.createDataFrame([(m, o) for m in range(12) for o in range(6) if (m + o) % 3], "member int, on int")
    key = lambda rows: sorted((r.member, r.peer, r.shared) for r in rows.collect())
    assert key(derived.strongest_peers(pairs, 4, block=2)) == key(derived.strongest_peers(pairs, 4))
    few = {(r.member, r.peer): r.w for r in networks.shared_links(pairs, 1, block=3).collect()}
    assert few == {(a, b): n for a in range(12) for b in range(12) if a != b and (n := sum(1 for o in range(6) if (a + o) % 3 and (b + o) % 3))}


def test_weighted_scores(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 1.0), (1, "b", 3.0, 9.0), (1, "c", 5.0, None), (1, "d", None, 4.0)], "trade_date int, ts_code string, x double, circ_mv double")
    got = {r.ts_code: r.z for r in rows.select("ts_code", weighted_zscore(F.col("x")).alias("z")).collect()}
    mean, var = (1 * 1 + 3 * 3) / 4, (1 * 1 + 3 * 9) / 4 - ((1 * 1 + 3 * 3) / 4) ** 2
    assert got["a"] == pytest.approx((1 - mean) / var**0.5) and got["b"] == pytest.approx((3 - mean) / var**0.5) and got["c"] is None and got["d"] is None
    both = composite(rows.withColumn("y", F.lit(None).cast("double")), ["x", "y"], "m")
    assert {r.ts_code: r.m for r in both.collect()}["a"] == pytest.approx(got["a"])


def test_holding_needs_its_returns(spark):
    rows = [(1, "P", t, f, r) for t, (f, r) in enumerate([(0.5, 1.0), (2.0, 10.0), (0.5, 5.0), (-2.0, 4.0), (0.5, None), (9.0, None)])]
    frame = spark.createDataFrame(rows, "trade_date int, product string, trade_time int, f double, r double")
    cuts = spark.createDataFrame([(1, "P", -1.0, 1.0)], "trade_date int, product string, lower double, upper double")
    r = futures.holding_report(frame, "f", "r", cuts).first()
    assert (r.holding_bp, r.positions, r.minutes) == (10.0 + 5.0 - 4.0, 2, 3)
    r = futures.holding_report(frame.withColumn("r", F.when(F.col("trade_time") != 2, F.col("r"))), "f", "r", cuts).first()
    assert r.holding_bp is None


def test_masks(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, True), (1, "b", 0.5, None), (1, "c", None, False)], "trade_date int, ts_code string, weight double, entry boolean")
    assert [r.weight for r in evaluation.masked_weights(rows, "weight", "entry").orderBy("ts_code").collect()] == [0.5, 0.0, None]


def test_prices_meet_limits_as_doubles_round(spark):
    """Halves of a cent, of which many print as a shorter decimal than the double is, and values without cents."""
    import duckdb

    closes = [*(round(0.005 + k / 200, 4) for k in range(1500)), 0.0, -0.125, float("nan"), float("inf"), 1e307, None]
    limits = [None if x is None else x * 1.5 for x in closes]
    frame = spark.createDataFrame([(1, f"S{i}", closes[i], limits[(i * 2 // 3)], limits[(i * 2 // 3)]) for i in range(len(closes))], "trade_date int, ts_code string, close double, up_limit double, down_limit double")
    got = {r.ts_code: (r.is_limit_up, r.is_limit_down) for r in sessions.tradeability(frame, frame, frame.limit(0)).collect()}
    con = duckdb.connect()
    sql = "select coalesce(round(?::double, 2) >= round(?::double, 2), false), coalesce(round(?::double, 2) <= round(?::double, 2), false)"
    want = {r.ts_code: con.execute(sql, [r.close, r.up_limit, r.close, r.down_limit]).fetchone() for r in frame.collect()}
    assert got == want and sum(u and d for u, d in want.values()) > 400


@pytest.mark.parametrize("pairs", [[(0, 1), (2, 5)], [(a, b) for a in range(8) for b in range(a + 1, 8) if b - a > 2]])
def test_two_steps_of_dense_and_sparse_links(spark, pairs):
    w = {k: 1 + sum(k) for a, b in itertools.combinations(range(8), 2) if (a, b) not in pairs for k in ((a, b), (b, a))}
    links = spark.createDataFrame([(*k, n) for k, n in w.items()], "member long, peer long, w long")
    found = networks._two_steps(links)
    ways = {(a, b): sum(w.get((a, k), 0) * w.get((k, b), 0) for k in range(8)) for a in range(8) for b in range(8) if a != b and (a, b) not in w}
    assert {(r.member, r.peer): r.w for r in found.collect()} == {k: n for k, n in ways.items() if n}
    assert ("Join Cross" in found._jdf.queryExecution().analyzed().toString()) == (len(pairs) == 2)  # of all pairs, those that aren't linked


def _means(held, values, least):
    """What SQL gives by walking all links, by member."""
    w = {(a, b): n for a in held for b in held if a != b and (n := len(held[a] & held[b])) >= least}
    mean = lambda ways: sum(x * y for x, y in ways) / sum(x for x, _ in ways) if ways else None
    out = {}
    for a in held:
        direct = [(w[a, b], values[b]) for b in held if (a, b) in w and values.get(b) is not None]
        ways = {b: sum(w.get((a, k), 0) * w.get((k, b), 0) for k in held) for b in held if b != a and (a, b) not in w and values.get(b) is not None}
        if direct:
            out[a] = (len(direct), pytest.approx(mean(direct), nan_ok=True), pytest.approx(mean([(n, values[b]) for b, n in ways.items() if n]), nan_ok=True))
    return out


@pytest.mark.parametrize(("share", "products", "indirect"), [(0.95, 10_000, False), (0.7, 10_000, True), (0.3, 10_000, True), (0.3, 0, True)])
def test_means_of_shared_links(spark, monkeypatch, share, products, indirect):
    """Complete, nearly complete and sparse, the last by products and by walking; repeated and null rows, peers with no value, NaN and infinity."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(networks, "_PRODUCTS", products)
    rows = [(f"m{m}", o) for m in range(24) for o in range(12) if rng.random() < share]
    held = {m: {o for x, o in rows if x == m} for m, _ in rows}
    if indirect:
        held |= {"few": {0, 1, 2}, "less": {1, 2}, "alone": {99}}
        rows += [(m, o) for m in ("few", "less", "alone") for o in held[m]]
    values = {m: float(i) for i, m in enumerate(held)} | {"m3": None, "m4": float("nan"), "m5": float("inf")}
    del values["m6"]
    pairs = spark.createDataFrame([*rows, *rows[:9], (None, 1), ("m1", None), ("null", None)], "member string, on int")
    given = spark.createDataFrame(list(values.items()), "member string, value double")
    found = networks.shared_means(pairs, given, 3, block=9)
    assert {r.member: (r.neighbours, r.direct, r.indirect) for r in found.collect()} == _means(held, values, 3)
    if not indirect:
        assert all(r.indirect is None for r in found.collect())


def test_a_complete_network_stores_no_links(spark, tmp_path):
    """700 suppliers that all share parts are 489,300 links; what stays on disk grows with the suppliers."""
    lines = spark.range(700 * 60).select((F.col("id") % 700).alias("l_suppkey"), (F.col("id") * 7919 % 83).alias("l_partkey"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    used = lambda: sum(x.diskSize() + x.memSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before = used()
    assert {(r.neighbours, r.indirect) for r in futures_queries.coverage_network(spark, str(tmp_path)).collect()} == {(699, None)}
    assert used() - before < 100_000
