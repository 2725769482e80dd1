"""Queries on elementwise helpers, sessions, memberships and point-in-time chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions import elementwise as el
from tessaly.functions.calendar import from_day
from tessaly.functions.timeseries import Rolling
from tessaly.operators import financial, sessions
from tessaly.plans.panel import PANEL_SQL, date_key, trade_cells, trade_panel
from tessaly.plans.ts_queries import KEYS, rounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir)
    x, z, w = F.col("x"), F.col("z"), F.col("w")
    code = F.concat(F.regexp_replace("ts_code", "^S", ""), F.when(F.substring("ts_code", -1, 1) == "5", F.lit(".BJ")).otherwise(F.lit(".SZ")))
    before = Rolling(2, 1).delay(z, 1)
    rows = panel.select(*KEYS, "x", "y", "z", "w", code.alias("code"), before.alias("before"))
    c, b = F.col("code"), F.col("before")
    return rows.select(
        *KEYS, rounded(el.safe_div(x, z)).alias("quotient"), rounded(el.arithmetic_return(z, b)).alias("ret"), rounded(el.log_return(z, b)).alias("log_ret"), rounded(el.daily_vwap(F.col("y"), x)).alias("day_price"),
        rounded(el.minute_vwap(F.col("y"), x)).alias("minute_price"), rounded(el.percent_to_decimal(x)).alias("part"), rounded(el.adjusted(z, w)).alias("adjusted"), rounded(el.sign_adjust(x, z - 1)).alias("signed"),
        rounded(el.without_exchange(x, c)).alias("without"), el.product_of(F.col("ts_code")).alias("product"), el.is_share_code(c).alias("share"), el.file_stem(c).alias("stem"),
        el.all_of([x > 1, z > 1, w > 2]).alias("masked"), el.allowed_by_limit("both", x > 2, z < 1).alias("allowed"),
    )


ELEMENTWISE = f"""with {PANEL_SQL}, b as (select *, lag(z) over (partition by ts_code order by trade_date) as before, substr(ts_code, 2) || case when right(ts_code, 1) = '5' then '.BJ' else '.SZ' end as code from panel)
select trade_date, ts_code, round(case when abs(z) > 1e-12 then x / z end, 6) + 0.0 as quotient, round(case when abs(before) > 1e-12 then z / before - 1 end, 6) + 0.0 as ret,
 round(case when z > 1e-12 and before > 1e-12 then ln(z / before) end, 6) + 0.0 as log_ret, round(case when x > 1e-12 then y * 10 / x end, 6) + 0.0 as day_price, round(case when x > 1e-12 then y / x end, 6) + 0.0 as minute_price,
 round(x / 100, 6) + 0.0 as part, round(z * w, 6) + 0.0 as adjusted, round(x * sign(z - 1), 6) + 0.0 as signed, round(case when code not like '%.BJ' then x end, 6) + 0.0 as without, 'S' as product,
 regexp_matches(code, '^[0-9]{{6}}\\.(SH|SZ|BJ)$') as share, regexp_replace(code, '[^A-Za-z0-9_-]', '_', 'g') as stem,
 coalesce(x > 1, false) and coalesce(z > 1, false) and coalesce(w > 2, false) as masked, not coalesce(x > 2 or z < 1, false) as allowed from b"""


def _open_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with orders that aren't a Saturday, Sunday or 13th."""
    days = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.filter((F.dayofweek("d").between(2, 6)) & (F.dayofmonth("d") != 13)).select(date_key(F.col("d")).alias("trade_date"))


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lineitem").select(date_key(F.col("l_shipdate")).alias("asked")).distinct()
    s = sessions.Sessions(_open_dates(spark, sf_dir))
    for f, out, more in ((s.first_on_or_after, "first_after", ()), (s.last_on_or_before, "last_before", ()), (s.previous, "previous", ()), (s.after, "after_5", (5,)), (s.warmup_start, "warmup_20", (20,)), (s.month_end_on_or_before, "month_end", ())):
        asked = f(asked, "asked", out, *more)
    return asked


CALENDAR = """with o as (select distinct o_orderdate::date as d from orders where isodow(o_orderdate) <= 5 and day(o_orderdate) <> 13),
s as (select strftime(d, '%Y%m%d')::int as d from o), p as (select d, row_number() over (order by d) as n, lead(d) over (order by d) as nx from s),
a as (select distinct strftime(l_shipdate, '%Y%m%d')::int as asked from lineitem)
select asked, (select min(d) from s where d >= asked) as first_after, (select max(d) from s where d <= asked) as last_before, (select max(d) from s where d < asked) as previous,
 (select q.d from p join p q on q.n = p.n + 5 where p.d = asked) as after_5,
 (select d from p where n = greatest(1, least((select count(*) + 1 from s where d < asked), (select count(*) from s)) - 20)) as warmup_20,
 (select max(d) from p where d <= asked and nx // 100 <> d // 100) as month_end from a"""


def tradeability(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir).withColumn("close", F.round(F.col("z") + 1, 4))
    before = Rolling(2, 1).delay(F.col("close"), 1)
    limits = panel.select(*KEYS, (before * 1.5).alias("up_limit"), (before * 0.6).alias("down_limit"), "w").filter("w > 3")
    return sessions.tradeability(panel.filter("present"), limits, panel.filter("w = 7"))


TRADEABLE = f"""with {PANEL_SQL}, c as (select *, round(z + 1, 4) as close from panel), b as (select *, lag(close) over (partition by ts_code order by trade_date) as before from c),
l as (select *, case when w > 3 then round(before * 1.5, 2) end as up, case when w > 3 then round(before * 0.6, 2) end as down from b where present),
f as (select *, coalesce(round(close, 2) >= up, false) as u, coalesce(round(close, 2) <= down, false) as d from l)
select trade_date, ts_code, u as is_limit_up, d as is_limit_down, u or d as is_limit, w = 7 as is_st from f"""


def members_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = trade_cells(spark, sf_dir)
    quarterly = cells.filter((F.floor(F.col("trade_date") / 100) % 100).isin(2, 5, 8, 11) & (F.col("w") >= 3)).select((F.col("trade_date") + 14).alias("effective_date"), "ts_code", F.col("w").alias("weight"))
    return sessions.members_as_of(cells.select("trade_date").distinct(), quarterly)


MEMBERS = f"""with {PANEL_SQL}, s as (select trade_date + 14 as e, ts_code, w as weight from named where (trade_date // 100) % 100 in (2, 5, 8, 11) and w >= 3),
d as (select distinct trade_date from named), a as (select trade_date, (select max(e) from s where e <= trade_date) as e from d) select trade_date, ts_code, weight from a join s using (e)"""


def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir)
    snapshots = panel.filter((F.floor(F.col("trade_date") / 100) % 3 == 0) & F.col("present")).select(*KEYS, "x", "z")
    return sessions.carried_forward(panel.select(*KEYS), snapshots, ["x", "z"]).select(*KEYS, rounded(F.col("x")).alias("x"), rounded(F.col("z")).alias("z"))


CARRIED = f"""with {PANEL_SQL}, s as (select * from named where (trade_date // 100) % 3 = 0), a as (select trade_date, (select max(s.trade_date) from s where s.trade_date <= d.trade_date) as e from (select distinct trade_date from named) d)
select p.trade_date, p.ts_code, round(s.x, 6) + 0.0 as x, round(s.z, 6) + 0.0 as z from panel p left join a on a.trade_date = p.trade_date left join s on s.trade_date = a.e and s.ts_code = p.ts_code"""


def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = trade_cells(spark, sf_dir)
    labels = cells.filter("z is not null and w > 1").select(*KEYS, F.col("z").alias("label"))
    return sessions.features_with_labels(cells.select(*KEYS, "x"), labels, KEYS).select(*KEYS, rounded(F.col("x")).alias("x"), rounded(F.col("label")).alias("label"))


FEATURE_LABELS = f"with {PANEL_SQL} select trade_date, ts_code, round(x, 6) + 0.0 as x, round(case when w > 1 then z end, 6) + 0.0 as label from named"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of quarterly values by supplier: several disclosures and kinds a quarter, some values missing."""
    lines = _table(spark, sf_dir, "lineitem")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    quarter = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    value = F.when((F.col("l_suppkey") + quarter) % 11 != 0, F.col("l_extendedprice"))
    rows = lines.select(F.col("l_suppkey").alias("key"), date_key(end).alias("period"), date_key(F.date_add(end, (20 + F.col("l_linenumber") * 7).cast("int"))).alias("disclosed"), (F.col("l_linenumber") % 4).alias("kind"), (F.col("l_linenumber") % 2).alias("update"), value.alias("v"))
    return rows.groupBy("key", "period", "disclosed", "kind", "update").agg((F.round(F.sum("v"), 2) / 1000).alias("value"))


def financial_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), date_key(F.trunc("l_shipdate", "month")).alias("trade_date")).distinct()
    out = financial.financial_chain(asked, _statements(spark, sf_dir), "key", "trade_date", "period", "disclosed", "kind", [3, 2, 0], "update", "value", 20, 3)
    return out.select("key", "trade_date", F.col("latest_quarter").cast("int").alias("latest_quarter"), "latest_year", *[rounded(F.col(c)).alias(c) for c in ("ttm", "annual", "annual_sum", "annual_first")])


CHAIN = """with r as (select l_suppkey as k, (date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day)::date as p, l_linenumber as n, (year(l_shipdate) * 4 + quarter(l_shipdate))::int as q, l_extendedprice as x from lineitem),
st as (select k, q, strftime(p + (20 + n * 7)::int, '%Y%m%d')::int as d, n % 4 as kind, n % 2 as u, round(sum(case when (k + q) % 11 <> 0 then x end), 2) / 1000 as v from r where n % 4 in (3, 2, 0) group by all),
ask as (select distinct l_suppkey as k, (year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1)::int as t from lineitem),
ev as (select ask.k, t, max(d) as e from ask left join st on st.k = ask.k and st.d <= t group by all),
vis as (select ev.k, t, q, v, row_number() over (partition by ev.k, t, q order by case kind when 3 then 1 when 2 then 2 else 3 end, d desc, u desc, v desc nulls last) as place
  from ev join st on st.k = ev.k and st.d <= e and q > ((e // 10000) * 4 + ((e // 100) % 100 + 2) // 3) - 20),
b as (select k, t, q, v from vis where place = 1),
l as (select k, t, max(q) as latest_quarter, max(q) filter (where q % 4 = 0) as lq from b group by all),
tt as (select k, t, arg_max(s, a) as ttm from (select x.k, x.t, x.q as a, sum(y.v) as s from b x join b y on x.k = y.k and x.t = y.t and y.q between x.q - 3 and x.q group by all having count(y.v) = 4) group by all),
yy as (select k, t, arg_max(s, a) as s, arg_max(f, a) as f from (select x.k, x.t, x.q as a, sum(y.v) as s, max(y.v) filter (where y.q = x.q - 8) as f from b x join b y on x.k = y.k and x.t = y.t and y.q in (x.q - 8, x.q - 4, x.q) where x.q % 4 = 0 group by all having count(y.v) = 3) group by all)
select ask.k as key, ask.t as trade_date, latest_quarter::int as latest_quarter, (lq // 4 - 1)::int as latest_year, round(ttm, 6) + 0.0 as ttm, round(b.v, 6) + 0.0 as annual, round(s, 6) + 0.0 as annual_sum, round(f, 6) + 0.0 as annual_first
from ask left join l using (k, t) left join tt using (k, t) left join yy using (k, t) left join b on b.k = ask.k and b.t = ask.t and b.q = lq"""


def dividend_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    paid = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("key"), from_day(day).alias("announced"), from_day(F.date_add(day, (F.col("o_orderkey") % 40 - 10).cast("int"))).alias("ex"), ((F.year(day) - 1) * 10000 + 1231).alias("fiscal"), F.round(F.col("o_totalprice") / 1000, 3).alias("cash"))
    asked = paid.select("key").distinct().crossJoin(F.broadcast(paid.select((F.floor(F.col("announced") / 100) * 100 + 15).cast("int").alias("trade_date")).distinct()))  # months by keys
    out = financial.dividend_sums(asked, paid, "key", "trade_date", "announced", "ex", "fiscal", "cash")
    return out.select("key", "trade_date", F.round(F.col("ltm") + 0.0, 3).alias("ltm"), F.round("last_year", 3).alias("last_year")).withColumn("ltm", F.col("ltm") + F.lit(0.0))


DIVIDENDS = """with p as (select o_custkey % 200 as key, o_orderdate::date as a, (o_orderdate::date + (o_orderkey % 40 - 10)::int) as x, year(o_orderdate) - 1 as y, round(o_totalprice / 1000, 3) as c from orders),
k as (select distinct key from p), m as (select distinct (date_trunc('month', a) + interval 14 day)::date as d from p), g as (select * from k cross join m)
select g.key, strftime(g.d, '%Y%m%d')::int as trade_date, round(coalesce(sum(c) filter (where x + interval 12 month >= g.d), 0), 3) + 0.0 as ltm, round(coalesce(sum(c) filter (where y = year(g.d) - 1), 0), 3) + 0.0 as last_year
from g left join p on p.key = g.key and p.a <= g.d and p.x <= g.d group by all"""

QUERIES = {
    "elementwise": elementwise, "trading_calendar": trading_calendar, "tradeability": tradeability, "members_as_of": members_as_of, "carried_forward": carried_forward, "feature_labels": feature_labels,
    "financial_chain": financial_chain, "dividend_sums": dividend_sums,
}
ORACLES = {
    "elementwise": ELEMENTWISE, "trading_calendar": CALENDAR, "tradeability": TRADEABLE, "members_as_of": MEMBERS, "carried_forward": CARRIED, "feature_labels": FEATURE_LABELS,
    "financial_chain": CHAIN, "dividend_sums": DIVIDENDS,
}
