"""Queries on futures minutes, path signatures, event strengths and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaly.operators import futures, networks, replay
from tessaly.plans.panel import PANEL_SQL, date_key, trade_cells, trade_panel
from tessaly.plans.ts_queries import rounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as minutes of contracts: users are 4 products of 3 contracts, quarters of an hour are minutes."""
    e = _table(spark, sf_dir, "events").filter("value > 0")
    product, code = F.concat(F.lit("P"), F.col("user_id") % 4), F.concat(F.lit("P"), F.col("user_id") % 4, F.lit("-"), F.floor(F.col("user_id") / 4) % 3)
    keys = [date_key(F.to_date("ts")).alias("trade_date"), product.alias("product"), code.alias("ts_code"), (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("trade_time")]
    return e.groupBy(*keys).agg(F.round(F.min_by("value", "event_id"), 4).alias("open"), F.round(F.max_by("value", "event_id"), 4).alias("close"), F.round(F.sum("value"), 4).alias("vol"))


def _main(rows: DataFrame) -> DataFrame:
    """The contract of most volume of each product and date; ties to the later code."""
    volume = rows.groupBy("trade_date", "product", "ts_code").agg(F.round(F.sum("vol"), 3).alias("v"))
    return volume.groupBy("trade_date", "product").agg(F.max_by("ts_code", F.struct("v", "ts_code")).alias("main"))


_MINUTES = """mi as (select (year(ts) * 10000 + month(ts) * 100 + day(ts))::int as trade_date, 'P' || user_id % 4 as product, 'P' || user_id % 4 || '-' || (user_id // 4) % 3 as ts_code, (hour(ts) * 4 + minute(ts) // 15)::int as trade_time,
 round(arg_min(value, event_id), 4) as open, round(arg_max(value, event_id), 4) as close, round(sum(value), 4) as vol from events where value > 0 group by all),
vo as (select trade_date, product, ts_code, round(sum(vol), 3) as v from mi group by all), mn as (select trade_date, product, arg_max(ts_code, {'v': v, 'c': ts_code}) as main from vo group by all),
mm as (select mi.* from mi join mn on mn.trade_date = mi.trade_date and mn.main = mi.ts_code)"""


def futures_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contract_minutes(spark, sf_dir)
    held = futures.main_minutes(rows.drop("product"), _main(rows))
    out = futures.stitched(held, ["open", "close"])
    return out.select("trade_date", "trade_time", "product", "ts_code", *[rounded(F.ln(c)).alias(f"log_{c}") for c in ("open", "close", "scale")])


STITCHED = f"""with {_MINUTES}, l as (select *, lag(ts_code) over o as pc, lag(close) over o as pp from mm window o as (partition by product order by trade_date, trade_time)), s as (select *, sum(case when pc <> ts_code and pp > 0 and open > 0 then ln(pp / open) else 0 end) over (partition by product order by trade_date, trade_time) as g from l)
select trade_date, trade_time, product, ts_code, round(ln(open) + g, 6) + 0.0 as log_open, round(ln(close) + g, 6) + 0.0 as log_close, round(g, 6) + 0.0 as log_scale from s"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contract_minutes(spark, sf_dir)
    return futures.minute_labels(futures.main_minutes(rows.drop("product"), _main(rows)))


def futures_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("trade_date", "trade_time", "ts_code", *[(F.round(F.col(f"future_open_return_{n}m"), 3) + F.lit(0.0)).alias(f"future_open_return_{n}m") for n in futures.MINUTE_LABELS])


FUTURES_LABELS = f"with {_MINUTES} select trade_date, trade_time, ts_code, " + ", ".join(f"round((lead(open, {n + 1}) over o / lead(open, 1) over o - 1) * 1e4, 3) + 0.0 as future_open_return_{n}m" for n in futures.MINUTE_LABELS) + " from mm window o as (partition by trade_date, ts_code order by trade_time)"


def futures_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails and holding of volume as the factor: thresholds of the last five sessions."""
    rows = _labelled(spark, sf_dir)
    cuts = futures.tail_thresholds(rows, "vol", 0.2, 5)
    tails = futures.tail_report(rows, "vol", "future_open_return_1m", cuts)
    out = tails.join(futures.holding_report(rows, "vol", "future_open_return_1m", cuts), ["trade_date", "product"], "left")
    return out.select("trade_date", "product", "upper_n", "lower_n", "positions", "minutes", *[(F.round(F.col(c), 3) + F.lit(0.0)).alias(c) for c in ("upper_bp", "lower_bp", "cosine", "holding_bp")])


FUTURES_BACKTEST = f"""with {_MINUTES}, r as (select *, (lead(open, 2) over o / lead(open, 1) over o - 1) * 1e4 as y, row_number() over (partition by trade_date, product order by trade_time desc) as left_ from mm window o as (partition by trade_date, ts_code order by trade_time)),
d as (select product, trade_date, dense_rank() over (partition by product order by trade_date) as n from (select distinct product, trade_date from r)), c as (select a.product, a.trade_date, quantile_cont(r.vol, 0.2) as lo, quantile_cont(r.vol, 0.8) as hi from d a join d b on a.product = b.product and b.n between a.n - 4 and a.n join r on r.product = b.product and r.trade_date = b.trade_date group by all),
j as (select r.*, lo, hi, case when vol > hi then 1.0 when vol < lo then -1.0 end as says from r join c using (product, trade_date)),
t as (select trade_date, product, avg(y) filter (where vol > hi) as ub, count(y) filter (where vol > hi) as un, avg(y) filter (where vol < lo) as lb, count(y) filter (where vol < lo) as ln_, sum(vol * y) / sqrt(sum(vol * vol) filter (where y is not null) * sum(y * y)) as cs from j group by all),
h as (select *, coalesce(last_value(says ignore nulls) over (partition by trade_date, product order by trade_time rows unbounded preceding), 0) as held from j where left_ > 2), k as (select *, coalesce(lag(held) over (partition by trade_date, product order by trade_time), 0) as bef from h),
g as (select trade_date, product, case when count(y) > 0 and count(*) filter (where held <> 0 and y is null) = 0 then sum(held * coalesce(y, 0)) end as hb, count(*) filter (where held <> bef) as positions, count(*) filter (where held <> 0) as minutes from k group by all)
select t.trade_date, t.product, un as upper_n, ln_ as lower_n, positions, minutes, round(ub, 3) + 0.0 as upper_bp, round(lb, 3) + 0.0 as lower_bp, round(cs, 3) + 0.0 as cosine, round(hb, 3) + 0.0 as holding_bp from t left join g using (trade_date, product)"""


def path_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contract_minutes(spark, sf_dir)
    out = networks.log_signature(rows, ["trade_date", "ts_code"], "trade_time", ["open", "close", "vol"])
    return out.select("trade_date", "ts_code", *[(F.round(F.col(c), 3) + F.lit(0.0)).alias(c) for c in ("s_open", "s_close", "s_vol", "a_open_close", "a_open_vol", "a_close_vol")])


SIGNATURES = f"""with {_MINUTES}, p as (select *, first_value(open) over o as o0, first_value(close) over o as c0, first_value(vol) over o as v0, lag(open) over o as po, lag(close) over o as pc, lag(vol) over o as pv from mi window o as (partition by trade_date, ts_code order by trade_time))
select trade_date, ts_code, round(coalesce(sum(open - po), 0), 3) + 0.0 as s_open, round(coalesce(sum(close - pc), 0), 3) + 0.0 as s_close, round(coalesce(sum(vol - pv), 0), 3) + 0.0 as s_vol,
 round(coalesce(sum((po - o0) * (close - pc) - (pc - c0) * (open - po)) / 2, 0), 3) + 0.0 as a_open_close, round(coalesce(sum((po - o0) * (vol - pv) - (pv - v0) * (open - po)) / 2, 0), 3) + 0.0 as a_open_vol, round(coalesce(sum((pc - c0) * (vol - pv) - (pv - v0) * (close - pc)) / 2, 0), 3) + 0.0 as a_close_vol from p group by all"""


def event_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("code"), F.to_date("ts").alias("day"), "event_type")
    kinds = ["click", "view", "purchase", "signup", "error"]
    out = networks.event_strengths(e, e.select(F.col("day").alias("at")).distinct(), "code", "day", "event_type", "at", kinds, 20, 60)
    return out.select("code", "at", *[rounded(F.col(f"s_{k}")).alias(f"s_{k}") for k in kinds])


EVENT_STRENGTHS = (
    "with e as (select user_id % 40 as code, ts::date as day, event_type from events), a as (select distinct day as at_ from e) select e.code, a.at_ as at, "
    + ", ".join(f"round(coalesce(sum(2.0 ** (-date_diff('day', e.day, a.at_) / 20.0)) filter (where event_type = '{k}'), 0), 6) + 0.0 as s_{k}" for k in ("click", "view", "purchase", "signup", "error"))
    + " from e join a on e.day <= a.at_ and date_diff('day', e.day, a.at_) <= 60 group by all"
)


def coverage_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers covered by the same part: mean quantity of direct neighbours, by how much they share, and of neighbours two steps away only."""
    lines = _table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_suppkey").alias("member"), (F.col("l_partkey") % 997).alias("on"))
    values = lines.groupBy(F.col("l_suppkey").alias("member")).agg(F.avg("l_quantity").alias("value"))
    return networks.shared_means(pairs, values, 3).select("member", "neighbours", rounded(F.col("direct")).alias("direct"), rounded(F.col("indirect")).alias("indirect"))


COVERAGE_NETWORK = """with p as (select distinct l_suppkey as member, l_partkey % 997 as k from lineitem), w as (select a.member, b.member as peer, count(*) as w from p a join p b on a.k = b.k and a.member <> b.member group by all having count(*) >= 3),
v as (select l_suppkey as member, avg(l_quantity) as value from lineitem group by all), d as (select w.member, count(*) as neighbours, sum(w * value) / sum(w) as direct from w join v on v.member = w.peer group by all),
t as (select a.member, b.peer, sum(a.w * b.w) as w from w a join w b on a.peer = b.member and b.peer <> a.member where not exists (select 1 from w c where c.member = a.member and c.peer = b.peer) group by all), i as (select t.member, sum(w * value) / sum(w) as indirect from t join v on v.member = t.peer group by all)
select member, neighbours, round(direct, 6) + 0.0 as direct, round(indirect, 6) + 0.0 as indirect from d left join i using (member)"""

QUERIES = {
    "futures_stitched": futures_stitched, "futures_labels": futures_labels, "futures_backtest": futures_backtest, "path_signatures": path_signatures, "event_strengths": event_strengths, "coverage_network": coverage_network,
}
ORACLES = {
    "futures_stitched": STITCHED, "futures_labels": FUTURES_LABELS, "futures_backtest": FUTURES_BACKTEST, "path_signatures": SIGNATURES, "event_strengths": EVENT_STRENGTHS, "coverage_network": COVERAGE_NETWORK,
}


def comparable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's number of rows against that of similar ones: cosine of (x, y, z) above 0.98."""
    cells = trade_cells(spark, sf_dir).filter("x is not null and y is not null and z is not null").select("trade_date", "ts_code", F.array("x", "y", "z").alias("v"), F.col("w").cast("double").alias("w"))
    out = networks.comparable_values(cells, "v", "w", least=0.98)
    return out.select("trade_date", "ts_code", *[rounded(F.col(c)).alias(c) for c in ("med", "max", "min", "avg", "weighted", "dst", "prm")])


COMPARABLE = f"""with {PANEL_SQL}, q as (select trade_date, ts_code, w::double as w, [x, y, z] as v from named where x is not null and y is not null and z is not null),
p as (select a.trade_date, a.ts_code, a.w as own, b.w, list_cosine_similarity(a.v, b.v) as s, row_number() over (partition by a.trade_date, a.ts_code order by list_cosine_similarity(a.v, b.v) desc, b.ts_code) as r from q a join q b on a.trade_date = b.trade_date and a.ts_code <> b.ts_code and list_cosine_similarity(a.v, b.v) > 0.98),
g as (select trade_date, ts_code, any_value(own) as own, median(w) filter (where r <= 6) as med, max(w) filter (where r <= 6) as mx, min(w) filter (where r <= 6) as mn, avg(w) as av, sum(s * w) / sum(s) as wt from p group by all)
select q.trade_date, q.ts_code, round(med, 6) + 0.0 as med, round(mx, 6) + 0.0 as max, round(mn, 6) + 0.0 as min, round(av, 6) + 0.0 as avg, round(wt, 6) + 0.0 as weighted, round(own - med, 6) + 0.0 as dst, round(own / med - 1, 6) + 0.0 as prm from q left join g using (trade_date, ts_code)"""


def chip_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = networks.chip_ages(trade_panel(spark, sf_dir).withColumn("turnover", F.col("w") / 20), days=24, edges=(2, 6, 12))
    return out.select("trade_date", "ts_code", *[rounded(F.col(f"age_{k}")).alias(f"age_{k}") for k in range(4)])


CHIP_AGES = f"""with {PANEL_SQL}, t as (select trade_date, ts_code, coalesce(w / 20, 0) as t, row_number() over o as n, sum(coalesce(w / 20, 0)) over o as c from panel window o as (partition by ts_code order by trade_date)),
m as (select a.trade_date, a.ts_code, a.n - b.n as age, (1 - exp(-b.t)) * exp(-(a.c - b.c)) as mass from t a join t b on a.ts_code = b.ts_code and b.n between a.n - 23 and a.n),
g as (select trade_date, ts_code, sum(mass) as s, sum(mass) filter (where age <= 2) as a0, sum(mass) filter (where age between 3 and 6) as a1, sum(mass) filter (where age between 7 and 12) as a2, sum(mass) filter (where age > 12) as a3 from m group by all)
select trade_date, ts_code, """ + ", ".join(f"round(case when s > 1e-15 then coalesce(a{k}, 0) / s end, 6) + 0.0 as age_{k}" for k in range(4)) + " from g"  # fmt: skip


def strategy_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio of the three best scores in each sector, with limits, distributions and delistings, as one run a sector."""
    cells = trade_cells(spark, sf_dir).filter("z is not null")
    order = Window.partitionBy("ts_code").orderBy("trade_date")
    last = F.lead("trade_date").over(order).isNull() & (F.substring("ts_code", -1, 1) == "3")
    rows = cells.select(
        F.concat(F.lit("R"), F.substring("ts_code", -2, 1)).alias("run"), "trade_date", F.col("ts_code").alias("symbol"), F.round(F.col("z") * 10 + 5, 2).alias("open"), F.round(F.col("z") * 10 + 5.2, 2).alias("close"), F.col("x").alias("score"),
        (F.col("w") > 9).alias("limit_up"), (F.col("w") < 2).alias("limit_down"), F.when(F.col("w") == 6, 0.1).otherwise(0.0).alias("stock_rate"), F.when(F.col("w") == 6, 0.2).otherwise(0.0).alias("cash_rate"),
        (F.col("trade_date") + 20).alias("ex_date"), (F.col("trade_date") + 120).alias("pay_date"), (F.col("trade_date") + 120).alias("listing_date"), last.alias("delisted"),
    )
    return replay.replay(rows, "run", replay.top_scores(3)).select("run", "trade_date", rounded(F.col("cash")).alias("cash"), rounded(F.col("equity")).alias("equity"), "holdings")


QUERIES |= {"comparable_values": comparable_values, "chip_ages": chip_ages, "strategy_portfolio": strategy_portfolio}
ORACLES |= {"comparable_values": COMPARABLE, "chip_ages": CHIP_AGES}
