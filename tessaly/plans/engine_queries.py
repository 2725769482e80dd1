"""Queries on joins, bars, backtests, calendars, storage and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaly.functions import calendar as cal
from tessaly.functions import kernels
from tessaly.functions import transforms as tf
from tessaly.operators import backtest as bt
from tessaly.operators import derived, joins, replay
from tessaly.operators.bars import bars
from tessaly.plans.panel import PANEL_SQL, date_key, trade_panel
from tessaly.plans.ts_queries import KEYS, rounded
from tessaly.sources import storage
from tessaly.streaming.bars import windowed_bars


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a one-step forward return of z, from the date after the signal on."""
    return trade_panel(spark, sf_dir).withColumn("label", bt.forward_return(F.col("z") + 1, 1))


_PRICED = f"with {PANEL_SQL}, q as (select *, lead(z + 1, 1) over (partition by ts_code order by trade_date) as p1, lead(z + 1, 2) over (partition by ts_code order by trade_date) as p2 from panel), b as (select *, p2 / p1 - 1 as label from q)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir)
    return panel.select(*KEYS, *[rounded(bt.forward_return(F.col("z") + 1, k)).alias(f"ret_{k}") for k in (1, 2, 5)])


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.information_coefficients(_priced(spark, sf_dir), "x", "label")
    return out.select("trade_date", rounded(F.col("ic")).alias("ic"), rounded(F.col("rank_ic")).alias("rank_ic"))


def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.ic_decay(_priced(spark, sf_dir), "x", "label", [1, 2, 3])
    return out.select("horizon", rounded(F.col("ic_mean")).alias("ic_mean"), "dates")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.group_returns(_priced(spark, sf_dir), "x", "label", 5)
    return out.select("trade_date", "grp_no", "members", rounded(F.col("ret")).alias("ret"))


def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.portfolio(bt.weighted(_priced(spark, sf_dir), "x"), "label")
    return out.select("trade_date", rounded(F.col("ret")).alias("ret"), rounded(F.col("turnover")).alias("turnover"))


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.weighted(_priced(spark, sf_dir), "x")
    out = bt.portfolio(bt.held_weights(rows, cal.rebalance_dates(rows, "quarterly")), "label")
    return out.select("trade_date", rounded(F.col("ret")).alias("ret"), rounded(F.col("turnover")).alias("turnover"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each group's monthly returns: panel, factor, label, groups and metrics in one plan."""
    out = bt.return_metrics(bt.group_returns(_priced(spark, sf_dir), "x", "label", 5), periods=12, keys=["grp_no"])
    return out.select("grp_no", "n", *[rounded(F.col(c)).alias(c) for c in out.columns[2:]])


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.factor_stats(trade_panel(spark, sf_dir), "x")
    return out.select("trade_date", "n", *[rounded(F.col(c)).alias(c) for c in out.columns[2:]])


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.summarised_stats(bt.factor_stats(trade_panel(spark, sf_dir), "x"))
    return out.select("year", "dates", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "coverage")])


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour bars of events by type: the value is the price, the id's last digit the volume."""
    events = _table(spark, sf_dir, "events").withColumn("trade_date", date_key(F.col("ts"))).withColumn("vol", (F.col("event_id") % 10).cast("double")).withColumn("amount", F.col("value") * F.col("vol"))
    out = bars(events, ["trade_date", "event_type"], F.floor(F.hour("ts") / 6).cast("int"), "event_id", dict.fromkeys(("open", "high", "low", "close"), "value"), "vol", "amount")
    return out.select("trade_date", "event_type", "bar_index", *[rounded(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "vol", "amount", "vwap")], "minute_count")


def asof_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order: the customer's latest earlier or equal event value, by day."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), date_key(F.col("o_orderdate")).alias("d"))
    lines = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("k"), date_key(F.col("l_shipdate")).alias("s"), F.col("l_orderkey").alias("v"))
    return joins.asof_join(orders, lines, ["k"], "d", "s", ["s", "v"], width=10_000)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority that was in force for each customer on ship dates, from intervals between orders."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), date_key(F.col("o_orderdate")).alias("in_date"), "o_orderpriority", "o_orderkey")
    order = Window.partitionBy("code").orderBy("in_date", "o_orderkey")
    intervals = orders.withColumn("out_date", F.lead("in_date").over(order)).select("code", "in_date", "out_date", F.col("o_orderpriority").alias("sector"))
    ends = _table(spark, sf_dir, "orders").select(date_key(F.last_day("o_orderdate")).alias("trade_date")).distinct()
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")).crossJoin(F.broadcast(ends))  # customers by month ends
    return joins.interval_join(asked, intervals, "trade_date", "code", "in_date", "out_date", "sector")


def disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time versions: line numbers are report types, order keys update flags, receipt by ship date."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("period"), date_key(F.col("l_shipdate")).alias("disclosed"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flag"), F.col("l_quantity").alias("v"))
    asked = lines.select("code", "period", (F.floor(F.col("disclosed") / 100) * 100 + 20).cast("int").alias("trade_date")).distinct()
    return joins.point_in_time(asked, lines, "code", "period", "trade_date", "disclosed", "l_linenumber", [2, 1, 5], "flag", ["v", "disclosed", "flag"])


def shifted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = trade_panel(spark, sf_dir).filter("present")
    return joins.shifted(cells.select(*KEYS, "z"), ["z"], 2).select(*KEYS, rounded(F.col("z_2")).alias("z_2"))


def trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    quarters = lines.groupBy(F.col("l_suppkey").alias("code"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("q")).agg(F.sum("l_quantity").alias("v"), F.count(F.lit(1)).alias("c")).filter("c >= 5")
    return joins.trailing_quarters(quarters, "code", "q", "v").select("code", "q", rounded(F.col("ttm")).alias("ttm"))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "orders").select(date_key(F.col("o_orderdate")).alias("trade_date"))
    parts = [cal.rebalance_dates(days, r).select(F.lit(str(r)).alias("rule"), "trade_date") for r in ("weekly", "biweekly", "monthly", "quarterly", "semiannual", "annual", 7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "orders").select(date_key(F.col("o_orderdate")).alias("d")).distinct()
    return days.select("d", cal.add_days(F.col("d"), 10).alias("plus_days"), cal.add_months(F.col("d"), 1).alias("plus_month"), cal.previous_quarter_end(F.col("d")).alias("quarter_before"), cal.month_end(F.col("d")).alias("month_end"), cal.week_number(F.col("d")).cast("long").alias("week"))


def column_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New columns over old rows: cells that the new rows hold replace the old ones, others stay."""
    panel = trade_panel(spark, sf_dir).filter("present")
    old = panel.filter("trade_date < 19970101").select(*KEYS, rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))
    new = panel.filter("trade_date >= 19960101").select(*KEYS, rounded(F.col("x") * 2).alias("x"), rounded(F.col("z")).alias("z"))
    return storage.merge_columns(old, new, KEYS)


def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "orders").select(date_key(F.col("o_orderdate")).alias("trade_date")).distinct()
    done = _table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(date_key(F.col("l_shipdate")).alias("trade_date"))
    return storage.missing(days, done, ["trade_date"])


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by customer and day, the first order's; dates that all segments share; union by name."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", date_key(F.col("o_orderdate")).alias("d"), "o_orderkey", "o_totalprice")
    return derived.first_by(orders, ["o_custkey", "d"], ["o_orderkey"])


def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.top_by(trade_panel(spark, sf_dir).filter("present"), ["trade_date"], "x", 3, "ts_code").select("trade_date", "ts_code", rounded(F.col("x")).alias("x"), "place")


def main_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main contract by date: brands are products, sizes maturities, quantities open interest."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"), (F.col("p_size") % 6).alias("maturity")), "l_partkey")
    interest = lines.groupBy("product", date_key(F.trunc("l_shipdate", "month")).alias("trade_date"), "maturity").agg(F.sum("l_quantity").cast("double").alias("oi"))
    return derived.main_contract(interest, "product", "trade_date", "maturity", "oi")


def liquid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir)
    return derived.liquid(panel, "w", 12, 6.0).select(*KEYS, "liquid")


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts: the strongest three of each by number of shared parts."""
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("on"))
    return derived.strongest_peers(pairs, 3)


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named transform of x as a feature and z as a label, and tail labels; ties come from rounding."""
    panel = trade_panel(spark, sf_dir).select(*KEYS, F.round("x", 1).alias("f"), F.round("z", 1).alias("l"), "x")
    out = panel.select(*KEYS, tf.tail_label(F.col("x"), 0.3).alias("tail"))
    for name in ("none", "zscore", "zscore_clip3", "zscore_log_rank", "zscore_erfinv_rank", "mad5_zscore_features", "mad5_zscore_rank_label"):
        made = tf.apply(panel, name, ["f"], ["l"])
        out = out.join(made.select(*KEYS, rounded(F.col("f")).alias(f"f_{name}"), rounded(F.col("l")).alias(f"l_{name}")), KEYS)
    return out


def kernel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.series_statistics(trade_panel(spark, sf_dir), "x")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving-average run for each supplier, on its monthly z as price."""
    bars_of = trade_panel(spark, sf_dir).filter("z is not null").select(F.col("ts_code").alias("run"), "trade_date", (F.col("z") * 10 + 5).alias("o"), (F.col("z") * 10 + 5).alias("c"))
    return replay.moving_average_runs(bars_of, "run", "trade_date", "o", "c", 3)


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event-time bars by type, by the code that also runs on a stream."""
    events = _table(spark, sf_dir, "events").select("ts", "event_type", "value")
    out = windowed_bars(events, "ts", "event_type", "value", "1 day", "1 hour")
    return out.select(date_key(F.col("start")).alias("trade_date"), "event_type", rounded(F.col("high")).alias("high"), rounded(F.col("low")).alias("low"), "n")


def event_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and month-end day, each halving in 20 days, by type."""
    events = _table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("code"), F.to_date("ts").alias("day"), "event_type")
    ends = events.select(F.last_day("day").alias("at")).distinct()
    return derived.decayed_events(events, ends, "code", "day", "event_type", "at", 20, 60).withColumn("strength", rounded(F.col("strength")))


_P = lambda c: f"case when {c} is not null and count({c}) over (partition by trade_date, {c} is null) > 1 then (row_number() over (partition by trade_date, {c} is null order by {c}, ts_code) - 1) / (count({c}) over (partition by trade_date, {c} is null) - 1) end"
_W = f"{_PRICED}, pp as (select *, {_P('x')} as p from b), cc as (select *, p - avg(p) over (partition by trade_date) as c from pp), ww as (select *, case when sum(abs(c)) over (partition by trade_date) > 1e-12 then c / sum(abs(c)) over (partition by trade_date) end as weight from cc)"
_PORT = ", dd as (select *, abs(coalesce(weight, 0) - coalesce(lag(coalesce(weight, 0)) over (partition by ts_code order by trade_date), 0)) as dw, lag(1) over (partition by ts_code order by trade_date) is null as fst from {t}) select trade_date, round(case when count(label) filter (where weight is not null) > 0 then sum(coalesce(weight * label, 0)) end, 6) + 0.0 as ret, round(case when not bool_and(fst) then sum(dw) / 2 end, 6) + 0.0 as turnover from dd group by trade_date"
_GROUPS = f"{_PRICED}, k as (select *, row_number() over (partition by trade_date order by x, ts_code) as rk, count(*) over (partition by trade_date) as n from b where x is not null), gg as (select *, least(floor((rk - 1) * 5 / n), 4)::integer as grp_no from k), gr as (select trade_date, grp_no, count(*) as members, case when count(label) > 0 then sum(coalesce(label, 0)) / count(*) end as ret from gg group by all)"
_KEY = "(year({0}) * 10000 + month({0}) * 100 + day({0}))::integer"
_STATS = f"with {PANEL_SQL}, st as (select trade_date, count(x) as n, avg(x) as mean, stddev_pop(x) as std, min(x) as min, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, max(x) as max, count(x) / count(*) as coverage from panel group by trade_date)"
_R = lambda *names: ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)

_MAIN_CONTRACT = """with recursive i as (select p_brand as product, (year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1)::int as trade_date, p_size % 6 as maturity, sum(l_quantity)::double as oi from lineitem join part on p_partkey = l_partkey group by all),
s as (select *, dense_rank() over (partition by product order by trade_date) as n from i),
r as (select product, n, arg_max(maturity, {'oi': oi, 'm': -maturity}) as main from s where n = 1 group by all
 union all
 select c.product, c.n, coalesce(arg_max(c.maturity, {'oi': c.oi, 'm': -c.maturity}) filter (where c.maturity > r.main and (o.oi is null or (c.oi > o.oi and c.oi * 10 >= o.oi * 11))), r.main) as main
 from r join s c on c.product = r.product and c.n = r.n + 1 left join s o on o.product = r.product and o.n = r.n + 1 and o.maturity = r.main group by c.product, c.n, r.main)
select s.product, s.trade_date, s.maturity as main, s.oi as main_interest from r join s on s.product = r.product and s.n = r.n and s.maturity = r.main"""


def _transforms_sql() -> str:
    rank = lambda c: f"case when {c} is not null then rank() over (partition by trade_date, {c} is null order by {c}) + (count(*) over (partition by trade_date, {c}) - 1) / 2.0 end"
    z = lambda c: f"case when {c} is not null then case when stddev_pop({c}) over d > 1e-12 then ({c} - avg({c}) over d) / stddev_pop({c}) over d else 0 end end"
    normal = lambda p: f"""case when {p} is null then null when {p} < 0.02425 or {p} > 0.97575 then case when {p} < 0.5 then 1 else -1 end
 * (((((-7.784894002430293e-03 * sqrt(-2 * ln(least({p}, 1 - {p}))) - 3.223964580411365e-01) * sqrt(-2 * ln(least({p}, 1 - {p}))) - 2.400758277161838e00) * sqrt(-2 * ln(least({p}, 1 - {p}))) - 2.549732539343734e00) * sqrt(-2 * ln(least({p}, 1 - {p}))) + 4.374664141464968e00) * sqrt(-2 * ln(least({p}, 1 - {p}))) + 2.938163982698783e00)
 / ((((7.784695709041462e-03 * sqrt(-2 * ln(least({p}, 1 - {p}))) + 3.224671290700398e-01) * sqrt(-2 * ln(least({p}, 1 - {p}))) + 2.445134137142996e00) * sqrt(-2 * ln(least({p}, 1 - {p}))) + 3.754408661907416e00) * sqrt(-2 * ln(least({p}, 1 - {p}))) + 1)
 else (((((-3.969683028665376e01 * ({p} - 0.5) ** 2 + 2.209460984245205e02) * ({p} - 0.5) ** 2 - 2.759285104469687e02) * ({p} - 0.5) ** 2 + 1.383577518672690e02) * ({p} - 0.5) ** 2 - 3.066479806614716e01) * ({p} - 0.5) ** 2 + 2.506628277459239e00) * ({p} - 0.5)
 / (((((-5.447609879822406e01 * ({p} - 0.5) ** 2 + 1.615858368580409e02) * ({p} - 0.5) ** 2 - 1.556989798598866e02) * ({p} - 0.5) ** 2 + 6.680131188771972e01) * ({p} - 0.5) ** 2 - 1.328068155288572e01) * ({p} - 0.5) ** 2 + 1) end"""  # noqa: E731
    r6 = lambda c: f"round({c}, 6) + 0.0"
    chosen = ", ".join(
        f"{r6(v)} as {n}" for n, v in {
            "f_none": "coalesce(f, 0)", "l_none": "l", "f_zscore": f"coalesce({z('f')}, 0)", "l_zscore": z("l"), "f_zscore_clip3": f"case when f is null then 0 else least(greatest({z('f')}, -3), 3) end", "l_zscore_clip3": z("l"),
            "f_zscore_log_rank": f"coalesce({z('flog')}, 0)", "l_zscore_log_rank": z("llog"), "f_zscore_erfinv_rank": f"coalesce({z('fnorm')}, 0)", "l_zscore_erfinv_rank": z("lnorm"),
            "f_mad5_zscore_features": f"coalesce({z('clip')}, 0)", "l_mad5_zscore_features": "l", "f_mad5_zscore_rank_label": f"coalesce({z('clip')}, 0)", "l_mad5_zscore_rank_label": z("lr"),
        }.items()
    )
    return f"""with {PANEL_SQL}, a as (select trade_date, ts_code, x, round(x, 1) as f, round(z, 1) as l from panel),
b as (select *, {rank('f')} as fr, count(f) over d as fn, {rank('l')} as lr, count(l) over d as ln, {rank('x')} as xr, count(x) over d as xn, quantile_cont(f, 0.5) over d as med from a window d as (partition by trade_date)),
c as (select *, quantile_cont(abs(f - med), 0.5) over d as mad from b window d as (partition by trade_date)),
e as (select *, ln(fr) as flog, ln(lr) as llog, {normal('((fr - 0.5) / fn)')} as fnorm, {normal('((lr - 0.5) / ln)')} as lnorm, case when f is not null then least(greatest(f, med - 5 * mad), med + 5 * mad) end as clip from c)
select trade_date, ts_code, case when (xr - 0.5) / xn >= 0.7 then 1 when (xr - 0.5) / xn <= 0.3 then 0 end as tail, {chosen} from e window d as (partition by trade_date)"""


_TRANSFORMS = _transforms_sql()

QUERIES = {
    "flagship_factor_report": flagship, "labels_forward": labels, "backtest_ic": information, "backtest_ic_decay": decay, "backtest_groups": groups, "backtest_long_short": long_short, "backtest_held": held,
    "factor_stats": stats, "factor_stats_summary": stats_summary, "bars_ohlc": event_bars, "join_asof": asof_prices, "join_interval": sectors, "join_point_in_time": disclosed, "join_shifted": shifted_labels,
    "trailing_quarters": trailing, "rebalance_dates": schedules, "date_functions": date_functions, "column_merge": column_merge, "missing_dates": missing_dates, "first_rows": first_rows, "top_names": top_names,
    "main_contract": main_contracts, "liquid_pool": liquid_pool, "strongest_peers": peers, "decayed_events": event_decay,
    "date_transforms": transforms, "series_kernels": kernel_statistics, "strategy_replay": replayed, "stream_bars": windowed,
}

ORACLES = {
    "flagship_factor_report": _GROUPS + ", rr as (select grp_no, trade_date, ret as r, product(1 + ret) over (partition by grp_no order by trade_date) as nav from gr where ret is not null), dn as (select *, nav / max(nav) over (partition by grp_no order by trade_date) - 1 as down from rr), ag as (select grp_no, count(*) as n, product(1 + r) - 1 as cumulative, avg(r) as m, stddev_samp(r) as s, stddev_samp(r) filter (where r < 0) as ng, min(down) as max_drawdown, avg((r > 0)::int) as win_rate from dn group by grp_no), an as (select *, (cumulative + 1) ** (12.0 / n) - 1 as annual, s * sqrt(12) as volatility, m * sqrt(12) / s as sharpe, m * sqrt(12) / ng as sortino from ag), fin as (select *, annual / abs(max_drawdown) as calmar from an) select grp_no, n, " + _R("cumulative", "annual", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate") + " from fin",
    "labels_forward": f"with {PANEL_SQL}, q as (select trade_date, ts_code, lead(z + 1, 1) over o as p1, lead(z + 1, 2) over o as p2, lead(z + 1, 3) over o as p3, lead(z + 1, 6) over o as p6 from panel window o as (partition by ts_code order by trade_date)) select trade_date, ts_code, round(p2 / p1 - 1, 6) + 0.0 as ret_1, round(p3 / p1 - 1, 6) + 0.0 as ret_2, round(p6 / p1 - 1, 6) + 0.0 as ret_5 from q",
    "backtest_ic": f"{_PRICED}, k as (select trade_date, x as f, label as r, {_P('x')} as pf, {_P('label')} as pr from b), m as (select trade_date, case when f is not null and r is not null then f end as f, case when f is not null and r is not null then r end as r, case when pf is not null and pr is not null then pf end as pf, case when pf is not null and pr is not null then pr end as pr from k) select trade_date, round(case when count(f) >= 2 then covar_pop(f, r) / (stddev_pop(f) * stddev_pop(r)) end, 6) + 0.0 as ic, round(case when count(pf) >= 2 then covar_pop(pf, pr) / (stddev_pop(pf) * stddev_pop(pr)) end, 6) + 0.0 as rank_ic from m group by trade_date",
    "backtest_ic_decay": f"{_PRICED}, k as (select trade_date, ts_code, x as f, label as l1, lead(label, 1) over o as l2, lead(label, 2) over o as l3 from b window o as (partition by ts_code order by trade_date)), u as (select 1 as horizon, trade_date, f, l1 as r from k union all select 2, trade_date, f, l2 from k union all select 3, trade_date, f, l3 from k), v as (select horizon, trade_date, case when r is not null then f end as f, case when f is not null then r end as r from u), i as (select horizon, trade_date, case when count(f) >= 2 then covar_pop(f, r) / (stddev_pop(f) * stddev_pop(r)) end as ic from v group by all) select horizon, round(avg(ic), 6) + 0.0 as ic_mean, count(ic) as dates from i group by horizon",
    "backtest_groups": _GROUPS + " select trade_date, grp_no, members, round(ret, 6) + 0.0 as ret from gr",
    "backtest_long_short": _W + _PORT.format(t="ww"),
    "backtest_held": _W + ", rb as (select trade_date from (select trade_date, trade_date // 10000 * 10 + (trade_date // 100 % 100 - 1) // 3 as p, lead(trade_date // 10000 * 10 + (trade_date // 100 % 100 - 1) // 3) over (order by trade_date) as np from (select distinct trade_date from ww)) where np is null or np <> p), hh as (select w.trade_date, w.ts_code, w.label, last_value(case when rb.trade_date is not null then {'w': w.weight} end ignore nulls) over (partition by w.ts_code order by w.trade_date) as k from ww w left join rb using (trade_date)), hw as (select trade_date, ts_code, label, k.w as weight from hh)" + _PORT.format(t="hw"),
    "factor_stats": _STATS + " select trade_date, n, " + _R("mean", "std", "min", "p25", "p50", "p75", "max", "coverage") + " from st",
    "factor_stats_summary": _STATS + ", y as (select *, (trade_date // 10000)::integer as year from st), z as (select year, count(*) as dates, avg(mean) as mean, avg(std) as std, avg(coverage) as coverage from y group by rollup (year)) select year, dates, " + _R("mean", "std", "coverage") + " from z",
    "bars_ohlc": f"with e as (select {_KEY.format('ts')} as trade_date, event_type, (hour(ts) // 6)::integer as bar_index, event_id, value, (event_id % 10)::double as vol from events where value is not null and isfinite(value)), a as (select trade_date, event_type, bar_index, arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, event_id) as close, sum(vol) as vol, sum(value * vol) as amount, count(*)::integer as minute_count from e group by all), v as (select *, case when vol > 0 then amount / vol when vol = 0 then 0.0 end as vwap from a) select trade_date, event_type, bar_index, {_R('open', 'high', 'low', 'close', 'vol', 'amount', 'vwap')}, minute_count from v",
    "join_asof": f"with o as (select o_orderkey, o_custkey % 50 as k, {_KEY.format('o_orderdate')} as d from orders), l as (select l_partkey % 50 as k, {_KEY.format('l_shipdate')} as s, l_orderkey as v from lineitem), m as (select k, s, max(v) as v from l group by all) select o.o_orderkey, o.k, o.d, m.s, m.v from o asof left join m on o.k = m.k and o.d >= m.s",
    "join_interval": f"with o as (select o_custkey as code, {_KEY.format('o_orderdate')} as in_date, o_orderpriority as sector, o_orderkey from orders), i as (select code, in_date, coalesce(lead(in_date) over (partition by code order by in_date, o_orderkey), 99991231) as out_date, sector from o), a as (select c_custkey as code, trade_date from customer cross join (select distinct (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(last_day(o_orderdate)))::integer as trade_date from orders)), j as (select a.code, a.trade_date, i.sector, row_number() over (partition by a.code, a.trade_date order by i.in_date desc, i.out_date desc, i.sector desc) as r from a left join i on a.code = i.code and i.in_date <= a.trade_date and a.trade_date <= i.out_date) select code, trade_date, sector from j where r = 1",
    "join_point_in_time": f"with l as (select l_suppkey as code, year(l_shipdate) * 4 + quarter(l_shipdate) as period, {_KEY.format('l_shipdate')} as disclosed, l_linenumber as t, l_orderkey * 10 + l_linenumber as flag, l_quantity as v from lineitem), a as (select distinct code, period, (disclosed // 100 * 100 + 20)::integer as trade_date from l), j as (select a.*, l.v, l.disclosed, l.flag, row_number() over (partition by a.code, a.period, a.trade_date order by case t when 2 then 1 when 1 then 2 else 3 end, l.disclosed desc, l.flag desc) as r from a left join l on a.code = l.code and a.period = l.period and l.disclosed <= a.trade_date and l.t in (1, 2, 5)) select code, period, trade_date, v, disclosed, flag from j where r = 1",
    "join_shifted": f"with {PANEL_SQL}, p as (select trade_date, ts_code, z from panel where present), o as (select trade_date, row_number() over (order by trade_date) as n from (select distinct trade_date from p)), q as (select p.*, o.n from p join o using (trade_date)) select a.trade_date, a.ts_code, round(b.z, 6) + 0.0 as z_2 from q a left join q b on a.ts_code = b.ts_code and b.n = a.n + 2",
    "trailing_quarters": "with q as (select l_suppkey as code, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::integer as q, sum(l_quantity) as v from lineitem group by all having count(*) >= 5) select code, q, round(case when count(v) over w = 4 then sum(v) over w end, 6) + 0.0 as ttm from q window w as (partition by code order by q range between 3 preceding and current row)",
    "rebalance_dates": "with d as (select distinct o_orderdate::date as dt, " + _KEY.format("o_orderdate") + " as trade_date from orders), k as (select trade_date, row_number() over (order by trade_date) - 1 as n, (date_diff('day', date '1970-01-01', dt) + 2) // 7 as wk, trade_date // 100 as mo, trade_date // 10000 * 10 + (trade_date // 100 % 100 - 1) // 3 as qu, trade_date // 10000 * 10 + (trade_date // 100 % 100 - 1) // 6 as sa, trade_date // 10000 as yr from d), l as (select *, lead(wk) over o as nwk, lead(mo) over o as nmo, lead(qu) over o as nqu, lead(sa) over o as nsa, lead(yr) over o as nyr from k window o as (order by trade_date)), w as (select trade_date, row_number() over (order by trade_date) - 1 as i from l where nwk is distinct from wk) select 'weekly' as rule, trade_date from w union all select 'biweekly', trade_date from w where i % 2 = 0 union all select 'monthly', trade_date from l where nmo is distinct from mo union all select 'quarterly', trade_date from l where nqu is distinct from qu union all select 'semiannual', trade_date from l where nsa is distinct from sa union all select 'annual', trade_date from l where nyr is distinct from yr union all select '7', trade_date from l where n % 7 = 0",
    "date_functions": "with d as (select distinct o_orderdate::date as t from orders) select " + _KEY.format("t") + " as d, " + _KEY.format("(t + 10)") + " as plus_days, " + _KEY.format("(t + interval 1 month)") + " as plus_month, " + _KEY.format("(date_trunc('quarter', t) - interval 1 day)") + " as quarter_before, " + _KEY.format("last_day(t)") + " as month_end, (date_diff('day', date '1970-01-01', t) + 2) // 7 as week from d",
    "column_merge": f"with {PANEL_SQL}, p as (select * from panel where present), o as (select trade_date, ts_code, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y from p where trade_date < 19970101), n as (select trade_date, ts_code, round(x * 2, 6) + 0.0 as x, round(z, 6) + 0.0 as z from p where trade_date >= 19960101) select coalesce(o.trade_date, n.trade_date) as trade_date, coalesce(o.ts_code, n.ts_code) as ts_code, case when n.ts_code is not null then n.x else o.x end as x, o.y, n.z from o full join n on o.trade_date = n.trade_date and o.ts_code = n.ts_code",
    "missing_dates": f"select distinct {_KEY.format('o_orderdate')} as trade_date from orders where {_KEY.format('o_orderdate')} not in (select {_KEY.format('l_shipdate')} from lineitem where l_quantity > 48)",
    "first_rows": f"select o_custkey, {_KEY.format('o_orderdate')} as d, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, {_KEY.format('o_orderdate')} order by o_orderkey) = 1",
    "top_names": f"with {PANEL_SQL} select trade_date, ts_code, round(x, 6) + 0.0 as x, row_number() over (partition by trade_date order by x desc, ts_code)::integer as place from panel where present and x is not null qualify place <= 3",
    "liquid_pool": f"with {PANEL_SQL} select trade_date, ts_code, coalesce(count(w) over f = 12 and avg(w) over f >= 6.0, false) as liquid from panel window f as (partition by ts_code order by trade_date rows between 12 preceding and 1 preceding)",
    "strongest_peers": "with p as (select distinct l_suppkey as member, l_partkey as k from lineitem), c as (select a.member, b.member as peer, count(*) as shared from p a join p b on a.k = b.k and a.member <> b.member group by all) select member, peer, shared, row_number() over (partition by member order by shared desc, peer)::integer as place from c qualify place <= 3",
    "decayed_events": "with e as (select user_id % 40 as code, ts::date as day, event_type from events), a as (select distinct last_day(day) as at from e) select e.code, a.at, e.event_type, round(sum(2.0 ** (-date_diff('day', e.day, a.at) / 20.0)), 6) + 0.0 as strength from e join a on e.day <= a.at and date_diff('day', e.day, a.at) <= 60 group by all",
    "stream_bars": f"select {_KEY.format('ts')} as trade_date, event_type, {_R('max(value)', 'min(value)').replace('as max(value)', 'as high').replace('as min(value)', 'as low')}, count(*) as n from events group by {_KEY.format('ts')}, event_type",
    "main_contract": _MAIN_CONTRACT, "date_transforms": _TRANSFORMS,
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
