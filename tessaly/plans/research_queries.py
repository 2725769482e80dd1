"""Queries on registered factors and labels, risk exposures, evaluation, intraday measures and analysts' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaly.functions.elementwise import daily_vwap
from tessaly.operators import derived, evaluation, exposures, intraday
from tessaly.operators.backtest import forward_return
from tessaly.plans import registry
from tessaly.plans.panel import PANEL_SQL, date_key, trade_panel
from tessaly.plans.ts_queries import KEYS, rounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier panel in market terms: prices, volume, turnover, float value, size, sector, returns."""
    p = trade_panel(spark, sf_dir).withColumn("close", F.col("z") + 1)
    before = F.lag("close").over(Window.partitionBy("ts_code").orderBy("trade_date"))
    p = p.select(
        *KEYS, "present", "close", (F.col("y") + 1).alias("open"), F.col("x").alias("vol"), F.col("y").alias("amount"), daily_vwap(F.col("y"), F.col("x")).alias("vwap"), (F.col("y") + F.col("z") + 1).alias("open_5m_vwap"),
        (F.col("x") + 2).alias("open_10m_vwap"), (F.lit(1.0) + F.floor(F.col("trade_date") / 10000) % 3).alias("adj"), (F.col("w") / 20).alias("turnover"), (F.col("w") + F.col("x")).alias("circ_mv"),
        F.log1p("w").alias("size"), F.col("grp").alias("sector"), (F.col("close") / before - 1).alias("ret"),
    )
    return p.withColumn("market", F.avg("ret").over(Window.partitionBy("trade_date")))


_MARKET = f"""{PANEL_SQL}, mk0 as (select trade_date, ts_code, present, z + 1 as close, y + 1 as open, x as vol, y as amount, case when x > 1e-12 then y * 10 / x end as vwap, y + z + 1 as open_5m_vwap, x + 2 as open_10m_vwap,
 1.0::double + (trade_date // 10000) % 3 as adj, w / 20 as turnover, w + x as circ_mv, ln(1 + w) as size, grp as sector, (z + 1) / lag(z + 1) over (partition by ts_code order by trade_date) - 1 as ret from panel),
mk as (select *, avg(ret) over (partition by trade_date) as market from mk0)"""


def labels_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = registry.select(among=registry.LABELS)
    out = registry.compute(market_panel(spark, sf_dir), specs)
    return out.select(*KEYS, *[rounded(F.col(s.id)).alias(s.id) for s in specs])


def _labels_sql() -> str:
    cells = []
    for s in registry.LABELS.values():
        kind, k = s.inputs[0], s.lookback - 1
        cells.append(f"round(case when abs(lead({kind} * adj, 1) over o) > 1e-12 then lead({kind} * adj, {k + 1}) over o / lead({kind} * adj, 1) over o - 1 end, 6) + 0.0 as {s.id}")
    return f"with {_MARKET}, l as (select trade_date, ts_code, present, {', '.join(cells)} from mk window o as (partition by ts_code order by trade_date)) select * exclude (present) from l where present"


def factor_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = registry.select()
    out = registry.compute(market_panel(spark, sf_dir), specs)
    return out.select(*KEYS, *[(F.round(F.col(s.id), 5) + F.lit(0.0)).alias(s.id) for s in specs])


def _factor_sql() -> str:
    cells, windows = [], []
    for n in (3, 6, 12):
        m, f = n // 2 + 1, f"f{n}"
        windows.append(f"{f} as (partition by ts_code order by trade_date rows between {n - 1} preceding and current row)")
        ok = lambda c, v: f"case when count({c}) over {f} >= {m} then {v} end"  # noqa: B023, E731
        l = f"list(ret) over {f}"  # noqa: E741
        pair = lambda a, b: f"list_filter(list({{'a': {a}, 'b': {b}}}) over {f}, lambda v: v.a is not null and v.b is not null)"  # noqa: B023, E731
        cells += [
            (f"momentum_{n}", f"case when abs(lag(close, {n}) over o) > 1e-12 then close / lag(close, {n}) over o - 1 end"), (f"volatility_{n}", ok("ret", f"stddev_pop(ret) over {f}")), (f"_l_{n}", l),
            (f"best_return_{n}", ok("ret", f"max(ret) over {f}")), (f"worst_return_{n}", ok("ret", f"min(ret) over {f}")), (f"_a_{n}", f"avg(ret) over {f}"), (f"_s_{n}", ok("ret", f"stddev_pop(ret) over {f}")),
            (f"downside_{n}", ok("ret", f"sqrt(avg(case when ret is not null then least(ret, 0) ** 2 end) over {f})")), (f"turnover_{n}", ok("turnover", f"avg(turnover) over {f}")), (f"turnover_deviation_{n}", ok("turnover", f"stddev_pop(turnover) over {f}")),
            (f"volume_surprise_{n}", ok("vol", f"case when abs(avg(vol) over {f}) > 1e-12 then vol / avg(vol) over {f} - 1 end")), (f"illiquidity_{n}", ok("ill", f"avg(ill) over {f}")), (f"_pv_{n}", pair("close", "vol")), (f"_rt_{n}", pair("ret", "turnover")), (f"_rm_{n}", pair("ret", "market")),
            (f"price_place_{n}", ok("close", f"case when max(close) over {f} > min(close) over {f} then (close - min(close) over {f}) / (max(close) over {f} - min(close) over {f}) end")), (f"vwap_gap_{n}", ok("gap", f"avg(gap) over {f}")),
        ]
    second = []
    for s in registry.FACTORS.values():
        if "neutral" in s.tags:
            continue
        name, n = s.id.rsplit("_", 1)
        m = int(n) // 2 + 1
        held = f"list_filter(_l_{n}, lambda v: v is not null)"
        corr = lambda h: f"case when len({h}) >= {m} and list_stddev_pop(list_transform({h}, lambda v: v.a)) * list_stddev_pop(list_transform({h}, lambda v: v.b)) > 2.3e-16 then (list_avg(list_transform({h}, lambda v: v.a * v.b)) - list_avg(list_transform({h}, lambda v: v.a)) * list_avg(list_transform({h}, lambda v: v.b))) / (list_stddev_pop(list_transform({h}, lambda v: v.a)) * list_stddev_pop(list_transform({h}, lambda v: v.b))) end"  # noqa: B023, E731
        second.append({
            "skewness": f"case when _s_{n} > 1e-12 then list_avg(list_transform({held}, lambda v: (v - _a_{n}) ** 3)) / _s_{n} ** 3 end", "kurtosis": f"case when _s_{n} > 1e-12 then list_avg(list_transform({held}, lambda v: (v - _a_{n}) ** 4)) / _s_{n} ** 4 end",
            "sharpe": f"case when _s_{n} > 2.3e-16 then _a_{n} / _s_{n} end", "price_volume": corr(f"_pv_{n}"), "return_turnover": corr(f"_rt_{n}"),
            "market_beta": f"case when len(_rm_{n}) >= {m} and list_var_pop(list_transform(_rm_{n}, lambda v: v.b)) > 2.3e-16 then (list_avg(list_transform(_rm_{n}, lambda v: v.a * v.b)) - list_avg(list_transform(_rm_{n}, lambda v: v.a)) * list_avg(list_transform(_rm_{n}, lambda v: v.b))) / list_var_pop(list_transform(_rm_{n}, lambda v: v.b)) end",
        }.get(name, s.id) + f" as {s.id}")
    z = lambda c: f"case when stddev_pop({c}) over d > 2.3e-16 then ({c} - avg({c}) over d) / stddev_pop({c}) over d end"
    clip = lambda c: f"case when {c} is not null then least(greatest({c}, quantile_cont({c}, 0.01) over d), quantile_cont({c}, 0.99) over d) end"
    steps = [
        ("s1", f"{clip('momentum_6')} as a1, {z('volatility_6')} as b1, turnover_12 as c1, {clip('market_beta_12')} as e1, row_number() over (partition by trade_date, illiquidity_12 is null order by illiquidity_12, ts_code) as gr, count(illiquidity_12) over d as gn"),
        ("s2", f"{z('a1')} as a2, case when illiquidity_12 is not null then least(greatest((gr - 0.5) / gn, 1e-6), 1 - 1e-6) end as p"),
    ]
    normal = """case when p is null then null when p < 0.02425 or p > 0.97575 then case when p < 0.5 then 1 else -1 end * (((((-7.784894002430293e-03 * sp - 3.223964580411365e-01) * sp - 2.400758277161838e00) * sp - 2.549732539343734e00) * sp + 4.374664141464968e00) * sp + 2.938163982698783e00)
 / ((((7.784695709041462e-03 * sp + 3.224671290700398e-01) * sp + 2.445134137142996e00) * sp + 3.754408661907416e00) * sp + 1) else (((((-3.969683028665376e01 * vp + 2.209460984245205e02) * vp - 2.759285104469687e02) * vp + 1.383577518672690e02) * vp - 3.066479806614716e01) * vp + 2.506628277459239e00) * (p - 0.5)
 / (((((-5.447609879822406e01 * vp + 1.615858368580409e02) * vp - 1.556989798598866e02) * vp + 6.680131188771972e01) * vp - 1.328068155288572e01) * vp + 1) end"""
    use = lambda c: f"{c} is not null and size is not null and sector is not null and sector <> ''"
    ys = {"na": "a2", "nb": "b1", "nc": "c1", "ni": "g1", "ne": "e1"}
    t1 = ", ".join(f"case when {use(c)} then {c} end as y_{k}, case when {use(c)} then size end as x_{k}" for k, c in ys.items())
    t2 = ", ".join(f"y_{k} - avg(y_{k}) over g as yc_{k}, x_{k} - avg(x_{k}) over g as xc_{k}" for k in ys)
    t3 = ", ".join(f"case when count(yc_{k}) over d >= 2 and sum(xc_{k} * xc_{k}) over d > 1e-12 then yc_{k} - sum(yc_{k} * xc_{k}) over d / sum(xc_{k} * xc_{k}) over d * xc_{k} end as r_{k}" for k in ys)
    final = {"momentum_6_neutral": "r_na", "volatility_6_neutral": "r_nb", "turnover_12_neutral": "coalesce(r_nc, case when sector is not null and sector <> '' and size is not null and count(r_nc) over g > 0 then 0.0 end)", "illiquidity_12_neutral": "r_ni", "market_beta_12_neutral": z("r_ne")}
    raw = ", ".join(f"round({s.id}, 5) + 0.0 as {s.id}" for s in registry.FACTORS.values() if "neutral" not in s.tags)
    return (
        f"with {_MARKET}, i as (select *, case when abs(amount) > 1e-12 then abs(ret) / amount end as ill, case when abs(vwap) > 1e-12 then close / vwap - 1 end as gap from mk), q as (select *, {', '.join(f'{v} as {k}' for k, v in cells)} from i window o as (partition by ts_code order by trade_date), {', '.join(windows)}),"
        f" base as (select trade_date, ts_code, size, sector, {', '.join(second)} from q where present), s1 as (select *, {steps[0][1]} from base window d as (partition by trade_date)), s2 as (select *, {steps[1][1]} from s1 window d as (partition by trade_date)),"
        f" s3 as (select *, (p - 0.5) ** 2 as vp, sqrt(-2 * ln(least(p, 1 - p))) as sp from s2), s4 as (select *, {normal} as g1 from s3), t1 as (select *, {t1} from s4), t2 as (select *, {t2} from t1 window g as (partition by trade_date, sector)),"
        f" t3 as (select *, {t3} from t2 window d as (partition by trade_date)) select trade_date, ts_code, {raw}, {', '.join(f'round({v}, 5) + 0.0 as {k}' for k, v in final.items())} from t3 window d as (partition by trade_date), g as (partition by trade_date, sector)"
    )


_MONTH, _YEAR, _LAG = 3, 12, 2


def risk_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exposures with months of 3 and years of 12 sessions, before they are standardised."""
    raw = exposures.raw_exposures(market_panel(spark, sf_dir), _MONTH, _YEAR, _LAG).filter("present")
    return raw.select(*KEYS, *[rounded(F.col(c)).alias(c.lower()) for c in raw.columns if c not in (*KEYS, "present", "circ_mv")])


def _exposure_sql() -> str:
    ew = lambda c, h: f"list_sum(list_transform(range(1, len({c}) + 1), lambda i: 0.5 ** ((len({c}) - i) / {h}) * {c}[i]))"
    weights = sum(0.5 ** (k / (_YEAR / 4)) for k in range(_YEAR))
    ranges = ", ".join(f"case when count(lr) over c{k} >= 1 then sum(lr) over c{k} end as k{k}" for k in range(1, _YEAR // _MONTH + 1))
    windows = ", ".join(f"c{k} as (partition by ts_code order by trade_date rows between {_MONTH * k - 1} preceding and current row)" for k in range(1, _YEAR // _MONTH + 1))
    names = ", ".join(f"k{k}" for k in range(1, _YEAR // _MONTH + 1))
    h = _YEAR / 4
    pw = f"list_transform(range(1, len(lp) + 1), lambda i: {{'w': 0.5 ** ((len(lp) - i) / {h}), 'y': lp[i].y, 'x': lp[i].x}})"
    s = lambda f: f"list_sum(list_transform(hp, lambda v: {f}))"
    dstd = f"list_filter(list_transform(range(1, len(rl) + 1), lambda i: {{'w': 0.5 ** ((len(rl) - i) / {_YEAR / 6}), 'x': rl[i]}}), lambda v: v.x is not null)"
    t = lambda f: f"list_sum(list_transform(hd, lambda v: {f}))"
    return f"""with {_MARKET}, a as (select *, case when ret > -1 then ln(1 + ret) end as lr from mk),
b as (select trade_date, ts_code, present, case when circ_mv > 0 then ln(circ_mv) end as size_, case when count(turnover) over c1 = {_MONTH} and sum(turnover) over c1 > 1e-12 then sum(turnover) over c1 end as tsum,
  case when count(turnover) over y = {_YEAR} then list(turnover) over y end as tl, list({{'y': ret, 'x': market}}) over y as lp, list(ret) over y as rl, list(lr) over y as ll, count(lr) over y as ln_, list(lr) over c1 as ls, count(lr) over c1 as lsn, count(ret) over y as rn, {ranges}
  from a window y as (partition by ts_code order by trade_date rows between {_YEAR - 1} preceding and current row), {windows}),
c as (select *, list_filter({pw}, lambda v: v.x is not null and v.y is not null) as hp, {dstd} as hd, case when ln_ >= 1 then {ew('ll', _YEAR / 2)} end as strength, case when lsn >= 1 then {ew('ls', _MONTH / 4)} end as reversal from b),
d as (select *, {s('v.w')} as w, {s('v.w * v.x')} as sx, {s('v.w * v.y')} as sy, {s('v.w * v.x * v.x')} as sxx, {s('v.w * v.x * v.y')} as sxy, {s('v.w * v.y * v.y')} as syy, {t('v.w')} as dw, {t('v.w * v.x')} as dx, {t('v.w * v.x * v.x')} as dxx from c),
e as (select *, sxx - sx * sx / w as vx, sxy - sx * sy / w as vxy, syy - sy * sy / w as vy from d),
f as (select *, case when w > 2.3e-16 and vx > 2.3e-16 then vxy / vx end as b_, lag(tsum, {_MONTH}) over o as t1, lag(tsum, {2 * _MONTH}) over o as t2, lag(tsum, {3 * _MONTH}) over o as t3, avg(strength) over (partition by ts_code order by trade_date rows between {2 * _LAG - 1} preceding and {_LAG} preceding) as rs, lag(reversal, 1) over o as rv from e window o as (partition by ts_code order by trade_date))
select trade_date, ts_code, round(size_, 6) + 0.0 as size, round(b_, 6) + 0.0 as beta, round(case when b_ is not null then sqrt(greatest((vy - b_ * vxy) / w, 0)) end, 6) + 0.0 as historical_sigma, round(case when rn >= 1 then sqrt(greatest((dxx - dx * dx / dw) / dw, 0)) end, 6) + 0.0 as daily_std,
 round(greatest({names}) - least({names}), 6) + 0.0 as cumulative_range, round(ln(tsum), 6) + 0.0 as monthly_share_turnover, round(ln((tsum + t1 + t2) / 3), 6) + 0.0 as quarterly_share_turnover, round(ln((tsum + t1 + t2 + t3) / 4), 6) + 0.0 as annual_share_turnover,
 round({ew('tl', h)} / {weights!r} * {_YEAR}, 6) + 0.0 as annualized_traded_value_ratio, round(case when b_ is not null then sy / w - b_ * sx / w end, 6) + 0.0 as historical_alpha, round(rs, 6) + 0.0 as relative_strength, round(rv, 6) + 0.0 as short_term_reversal from f where present"""


def exposure_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exposures.risk_exposures(market_panel(spark, sf_dir), _MONTH, _YEAR, _LAG)
    return out.select(*KEYS, *[(F.round(F.col(c), 5) + F.lit(0.0)).alias(c.lower() if c != "SIZE" else "size_family") for c in ("Mid_Cap", "Beta", "SIZE", "VOLATILITY", "LIQUIDITY", "MOMENTUM")])


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a one-step label, a signal universe, an entry mask, index weights and two exposures."""
    p = trade_panel(spark, sf_dir).withColumn("label", forward_return(F.col("z") + 1, 1))
    return p.select(*KEYS, "x", "y", "z", "w", "grp", "label", (F.col("w") >= 3).alias("signal"), (F.substring("ts_code", -1, 1) != "7").alias("entry"), F.when(F.col("w") > 4, F.col("w")).cast("double").alias("index_weight"))


_EVAL = f"{PANEL_SQL}, ev as (select *, lead(z + 1, 2) over o / lead(z + 1, 1) over o - 1 as label, w >= 3 as signal, right(ts_code, 1) <> '7' as entry, case when w > 4 then w::double end as index_weight from panel window o as (partition by ts_code order by trade_date))"


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir)
    market = evaluation.market_benchmark(rows, "label", "signal", "entry").withColumnRenamed("benchmark", "market")
    index = evaluation.weighted_benchmark(rows, "label", "index_weight", "entry").withColumnRenamed("benchmark", "index")
    return market.join(index, "trade_date").select("trade_date", rounded(F.col("market")).alias("market"), rounded(F.col("index")).alias("index_ret"))


BENCHMARKS = f"with {_EVAL} select trade_date, round(sum(case when entry then label else label * 0 end) filter (where signal) / count(label) filter (where signal), 6) + 0.0 as market, round(sum(case when entry then index_weight * label else 0 end) filter (where index_weight is not null and label is not null) / sum(index_weight) filter (where label is not null), 6) + 0.0 as index_ret from ev group by trade_date"


def index_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five groups by x among index members, entry blocked where masked, against the index's own return."""
    rows = evaluated(spark, sf_dir).withColumn("member", F.col("index_weight").isNotNull())
    groups = evaluation.group_portfolios(rows, "x", "label", 5, "member", "entry")
    out = evaluation.with_excess(groups, evaluation.weighted_benchmark(rows, "label", "index_weight", "entry"))
    return out.select("trade_date", "portfolio", "members", *[rounded(F.col(c)).alias(c) for c in ("ret", "benchmark", "excess")])


INDEX_GROUPS = f"""with {_EVAL}, k as (select *, row_number() over (partition by trade_date order by x, ts_code) as r, count(*) over (partition by trade_date) as n from ev where x is not null and index_weight is not null),
g as (select trade_date, 'group_' || (least(floor((r - 1) * 5 / n), 4)::int + 1) as portfolio, count(*) as members, case when count(label) filter (where entry) > 0 then sum(case when entry then coalesce(label, 0) else 0 end) / count(*) end as ret from k group by all),
b as (select trade_date, sum(case when entry then index_weight * label else 0 end) filter (where index_weight is not null and label is not null) / sum(index_weight) filter (where label is not null) as benchmark from ev group by trade_date)
select g.trade_date, portfolio, members, round(ret, 6) + 0.0 as ret, round(benchmark, 6) + 0.0 as benchmark, round(ret - benchmark, 6) + 0.0 as excess from g left join b using (trade_date)"""


def signed_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir)
    groups = evaluation.group_portfolios(rows, "x", "label", 5)
    out = evaluation.signed_report(groups, evaluation.rank_ic_sign(rows, "x", "label"), 5)
    return out.select("trade_date", "sign", "long_group", *[rounded(F.col(c)).alias(c) for c in ("long_short", "long_ret")])


def _pct(c: str) -> str:
    return f"case when {c} is not null and count({c}) over (partition by trade_date, {c} is null) > 1 then (row_number() over (partition by trade_date, {c} is null order by {c}, ts_code) - 1) / (count({c}) over (partition by trade_date, {c} is null) - 1) end"


SIGNED = f"""with {_EVAL}, pr as (select trade_date, {_pct('x')} as a, {_pct('label')} as b from ev), ic as (select trade_date, case when count(*) >= 2 and var_pop(a) > 1e-12 and var_pop(b) > 1e-12 then corr(a, b) end as ic from pr where a is not null and b is not null group by trade_date),
sg as (select case when avg(ic) < 0 then -1.0::double else 1.0::double end as sign from ic), k as (select *, row_number() over (partition by trade_date order by x, ts_code) as r, count(*) over (partition by trade_date) as n from ev where x is not null),
g as (select trade_date, least(floor((r - 1) * 5 / n), 4)::int + 1 as p, case when count(label) > 0 then sum(coalesce(label, 0)) / count(*) end as ret from k group by all), e as (select trade_date, max(ret) filter (where p = 5) as hi, max(ret) filter (where p = 1) as lo from g group by trade_date)
select trade_date, sign, case when sign < 0 then 'group_1' else 'group_5' end as long_group, round((hi - lo) * sign, 6) + 0.0 as long_short, round(case when sign < 0 then lo else hi end, 6) + 0.0 as long_ret from e cross join sg"""


def exposure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).withColumn("big", F.log1p("w"))
    ic = evaluation.exposure_ic(rows, "x", ["y", "big"])
    held = evaluation.masked_weights(rows.withColumn("weight", F.when(F.col("x").isNotNull(), 1 / F.count("x").over(Window.partitionBy("trade_date")))), "weight", "entry")
    value = evaluation.weighted_exposure(held, "weight", ["y", "big"]).withColumnRenamed("pairs", "held")
    return ic.join(value, ["trade_date", "exposure"]).select("trade_date", "exposure", rounded(F.col("ic")).alias("ic"), "pairs", rounded(F.col("value")).alias("value"), "held")


EXPOSURE_REPORT = " union all ".join(
    f"(with {_EVAL} select trade_date, '{name}' as exposure, round(case when count(*) filter (where x is not null and {e} is not null) >= 2 and var_pop(case when {e} is not null then x end) > 1e-12 and var_pop(case when x is not null then {e} end) > 1e-12 then corr(x, {e}) end, 6) + 0.0 as ic, count(*) filter (where x is not null and {e} is not null) as pairs, round(avg({e}) filter (where x is not null and entry), 6) + 0.0 as value, count({e}) filter (where x is not null and entry) as held from ev group by trade_date)"
    for name, e in (("y", "y"), ("big", "ln(1 + w)"))
)


def industry_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).withColumn("weight", F.when(F.col("x") > 1, F.col("x")))
    return evaluation.industry_weights(rows, "weight", "grp").select("trade_date", "industry", rounded(F.col("weight")).alias("weight"), "names")


INDUSTRIES = f"with {PANEL_SQL} select trade_date, case when grp is null or grp = '' then 'unknown' else grp end as industry, round(sum(x), 6) + 0.0 as weight, count(*) as names from panel where x > 1 group by all"


def factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).withColumn("f", F.when(F.col("w") == 5, F.lit(float("inf"))).otherwise(F.col("x")))
    return evaluation.coverage(rows, "f", "signal").select("trade_date", "universe", "present", "finite", "infinite", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("inf_rate")).alias("inf_rate"))


COVERAGE = f"with {_EVAL}, f as (select *, case when w = 5 then 'inf'::double else x end as f from ev where signal), a as (select distinct trade_date from ev) select a.trade_date, count(f.ts_code) as universe, count(f) as present, count(f) filter (where isfinite(f)) as finite, count(f) filter (where isinf(f)) as infinite, round(case when count(f.ts_code) > 0 then count(f) filter (where isfinite(f)) / count(f.ts_code) end, 6) + 0.0 as coverage, round(case when count(f.ts_code) > 0 then count(f) filter (where isinf(f)) / count(f.ts_code) end, 6) + 0.0 as inf_rate from a left join f using (trade_date) group by a.trade_date"


def yearly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.group_portfolios(evaluated(spark, sf_dir), "x", "label", 3)
    scaled = rows.withColumn("ret", F.col("ret") / 10)
    return evaluation.report_by_year(scaled, "ret", ["portfolio"]).select("portfolio", "year", "days", *[rounded(F.col(c)).alias(c) for c in ("mean", "compounded", "deviation", "gains")])


_THIRDS = f"{_EVAL}, k as (select *, row_number() over (partition by trade_date order by x, ts_code) as r, count(*) over (partition by trade_date) as n from ev where x is not null), g as (select trade_date, 'group_' || (least(floor((r - 1) * 3 / n), 2)::int + 1) as portfolio, case when count(label) > 0 then sum(coalesce(label, 0)) / count(*) / 10 end as ret from k group by all)"
YEARLY = f"with {_THIRDS}, h as (select portfolio, (trade_date // 10000)::int as year, ret from g where ret is not null) select portfolio, year, count(*) as days, round(avg(ret), 6) + 0.0 as mean, round(product(1 + ret) - 1, 6) + 0.0 as compounded, round(stddev_samp(ret), 6) + 0.0 as deviation, round(avg((ret > 0)::int), 6) + 0.0 as gains from h group by grouping sets ((portfolio, year), (portfolio))"


def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.group_portfolios(evaluated(spark, sf_dir), "x", "label", 3).withColumn("ret", F.col("ret") / 10)
    return evaluation.drawdown_episodes(rows, "ret", ["portfolio"]).select("portfolio", "peak_date", "low_date", "end_date", rounded(F.col("depth")).alias("depth"), "sessions")


DRAWDOWNS = f"""with {_THIRDS}, n as (select portfolio, trade_date, round(product(1 + ret) over (partition by portfolio order by trade_date rows unbounded preceding), 12) as nav, lead(trade_date) over (partition by portfolio order by trade_date) as nx from g where ret is not null),
p as (select *, max(nav) over (partition by portfolio order by trade_date rows unbounded preceding) as peak from n), e as (select *, nav / peak - 1 as down, sum((nav >= peak)::int) over (partition by portfolio order by trade_date rows unbounded preceding) as ep from p)
select portfolio, min(trade_date) as peak_date, arg_min(trade_date, {{'d': down, 't': trade_date}}) as low_date, arg_max_null(nx, trade_date) as end_date, round(min(down), 6) + 0.0 as depth, count(*) - 1 as sessions from e group by portfolio, ep having count(*) > 1"""


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as minutes: quarters of an hour are the minutes, the mean value the price, users in 5 instruments."""
    e = _table(spark, sf_dir, "events").filter("value > 0")
    rows = e.groupBy(date_key(F.to_date("ts")).alias("trade_date"), F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("ts_code"), (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("minute"))
    return rows.agg(F.round(F.avg("value"), 6).alias("price"), F.count(F.lit(1)).cast("double").alias("vol"))


_TICKS = "tk as (select (year(ts) * 10000 + month(ts) * 100 + day(ts))::int as trade_date, 'U' || (user_id % 5) as ts_code, (hour(ts) * 4 + minute(ts) // 15)::int as minute, round(avg(value), 6) as price, count(*)::double as vol from events where value > 0 group by all)"


def minute_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ticks(spark, sf_dir)
    days = intraday.daily(rows, {"bars": F.count(F.lit(1)), "vwap": F.sum(F.col("price") * F.col("vol")) / F.sum("vol"), "first": F.min_by("price", "minute"), "last": F.max_by("price", "minute")}, 8, 88)
    sums = intraday.rolled(intraday.pair_sums(rows, "vol", "price"), ["n", "sx", "sy", "sxx", "sxy", "syy"], 2)
    out = days.join(intraday.restored(sums), KEYS)
    return out.select(*KEYS, "bars", *[(F.round(F.col(c), 5) + F.lit(0.0)).alias(c) for c in ("vwap", "first", "last", "covariance", "slope", "correlation")])


MINUTE_DAILY = f"""with {_TICKS}, d as (select trade_date, ts_code, count(*) as bars, sum(price * vol) / sum(vol) as vwap, arg_min(price, minute) as first, arg_max(price, minute) as last from tk where minute between 8 and 88 group by all),
m as (select distinct trade_date, ts_code, dense_rank() over (partition by ts_code order by trade_date) as n from tk), p as (select m.trade_date, m.ts_code, tk.vol as x, tk.price as y from m join m b on b.ts_code = m.ts_code and b.n between m.n - 1 and m.n join tk on tk.ts_code = b.ts_code and tk.trade_date = b.trade_date),
c as (select trade_date, ts_code, covar_pop(y, x) as covariance, case when var_pop(x) > 1e-12 then covar_pop(y, x) / var_pop(x) end as slope, case when var_pop(x) > 1e-12 and var_pop(y) > 1e-12 then covar_pop(y, x) / sqrt(var_pop(x) * var_pop(y)) end as correlation from p group by all)
select trade_date, ts_code, bars, round(vwap, 5) + 0.0 as vwap, round(first, 5) + 0.0 as first, round(last, 5) + 0.0 as last, round(covariance, 5) + 0.0 as covariance, round(slope, 5) + 0.0 as slope, round(correlation, 5) + 0.0 as correlation from d join c using (trade_date, ts_code)"""


def intraday_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intraday.market_residuals(intraday.log_returns(_ticks(spark, sf_dir), "price"))
    raw = intraday.tail_risk(rows, "r", 0.1)
    own = intraday.tail_risk(rows, "residual", 0.05).select(*KEYS, *[F.col(c).alias(f"res_{c}") for c in ("realised", "var_left", "cvar_left")])
    return raw.join(own, KEYS).select(*KEYS, "n", *[(F.round(F.col(c), 5) + F.lit(0.0)).alias(c) for c in ("realised", "var_left", "var_right", "cvar_left", "cvar_right", "res_realised", "res_var_left", "res_cvar_left")])


INTRADAY_RISK = f"""with {_TICKS}, r0 as (select *, ln(price / lag(price) over (partition by trade_date, ts_code order by minute)) as r from tk), r1 as (select *, avg(r) over (partition by trade_date, minute) as market from r0),
r2 as (select *, case when r is not null and market is not null then market end as x, case when market is not null then r end as y from r1),
r3 as (select *, case when count(x) over w >= 3 then y - avg(y) over w - covar_pop(y, x) over w / nullif(var_pop(x) over w, 0) * (market - avg(x) over w) end as residual from r2 window w as (partition by trade_date, ts_code)),
c as (select trade_date, ts_code, quantile_cont(r, 0.1) as lo, quantile_cont(r, 0.9) as hi, quantile_cont(residual, 0.05) as rl from r3 group by all)
select trade_date, ts_code, count(r) as n, round(sum(r * r), 5) + 0.0 as realised, round(-any_value(lo), 5) + 0.0 as var_left, round(any_value(hi), 5) + 0.0 as var_right, round(-avg(r) filter (where r <= lo), 5) + 0.0 as cvar_left, round(avg(r) filter (where r >= hi), 5) + 0.0 as cvar_right,
 round(sum(residual * residual), 5) + 0.0 as res_realised, round(-any_value(rl), 5) + 0.0 as res_var_left, round(-avg(residual) filter (where residual <= rl), 5) + 0.0 as res_cvar_left from r3 join c using (trade_date, ts_code) group by all"""


def analyst_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports: customers' nations are institutions, order keys by 20 instruments, prices forecasts."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("org"))
    reports = _table(spark, sf_dir, "orders").join(customers, "o_custkey").select((F.col("o_orderkey") % 20).alias("code"), "org", (F.year("o_orderdate") + F.col("o_orderkey") % 2).cast("int").alias("year"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 997).alias("eps"))
    dates = reports.select(F.last_day("day").alias("day")).distinct()
    annual = derived.consensus(reports, dates, "code", "org", "year", "day", "eps", (90, 120, 183), 8)
    rolling = derived.rolling_year(annual, "code", "year", "day", "wide")
    return annual.join(rolling, ["code", "day"]).select("code", "year", "day", *[rounded(F.col(c)).alias(c) for c in ("strict", "wide", "rolling")], "used", "institutions")


CONSENSUS = """with r as (select o_orderkey % 20 as code, c_nationkey as org, (year(o_orderdate) + o_orderkey % 2)::int as year, o_orderdate::date as day, o_totalprice / 997 as eps from orders join customer on c_custkey = o_custkey), d as (select distinct last_day(day) as dt from r),
n as (select code, org, year, dt, date_diff('day', day, dt) as age, eps from r join d on day <= dt and date_diff('day', day, dt) < 183), l as (select code, year, dt, org, min(age) as age, arg_max(eps, {'a': -age, 'v': eps}) as v from n group by all),
a as (select code, year, dt, count(v) filter (where age < 90) as n1, avg(v) filter (where age < 90) as m1, count(v) filter (where age < 120) as n2, avg(v) filter (where age < 120) as m2, count(v) as n3, avg(v) as m3 from l group by all),
w as (select code, year, dt, case when n1 >= 8 then m1 end as strict, case when n1 >= 8 then m1 when n2 >= 8 then m2 when n3 >= 8 then m3 end as wide, case when n1 >= 8 then 90 when n2 >= 8 then 120 when n3 >= 8 then 183 end as used, case when n1 >= 8 then n1 when n2 >= 8 then n2 when n3 >= 8 then n3 end as institutions from a),
f as (select code, dt, max(wide) filter (where year = year(dt)) as a0, max(wide) filter (where year = year(dt) + 1) as b0, date_diff('day', dt, make_date(year(dt), 12, 31)) / 365.0::double as p from w group by all)
select w.code, w.year, w.dt as day, round(strict, 6) + 0.0 as strict, round(wide, 6) + 0.0 as wide, round(a0 * p + b0 * (1 - p), 6) + 0.0 as rolling, used, institutions from w join f using (code, dt)"""


def concept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's parts of a quarter as a disclosure of what it belongs to, in force from the quarter's end on."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), date_key(F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))).alias("available"), (F.col("l_partkey") % 40).alias("concept"))
    told = lines.filter("(owner + floor(available / 100)) % 4 <> 0").groupBy("owner", "available").agg(F.collect_set(F.when(F.col("concept") < 12, F.col("concept"))).alias("members"))
    dates = _table(spark, sf_dir, "lineitem").select(date_key(F.trunc("l_shipdate", "month")).alias("trade_date")).distinct()
    return derived.snapshot_members(told, dates, "owner", "available", "members")


CONCEPTS = """with l as (select l_suppkey as owner, strftime((date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day)::date, '%Y%m%d')::int as available, l_partkey % 40 as c from lineitem), t as (select owner, available, list(distinct c) filter (where c < 12) as m from l where (owner + available // 100) % 4 <> 0 group by all),
d as (select distinct (year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1)::int as trade_date from lineitem), a as (select d.trade_date, t.owner, max(t.available) as available from d join t on t.available <= d.trade_date group by all)
select trade_date, a.owner, unnest(m) as member from a join t on t.owner = a.owner and t.available = a.available"""

QUERIES = {
    "labels_registered": labels_registered, "factor_library": factor_library, "risk_exposures": risk_exposures, "exposure_composites": exposure_composites, "benchmarks": benchmarks, "index_groups": index_groups,
    "signed_backtest": signed_backtest, "exposure_report": exposure_report, "industry_weights": industry_weights, "factor_coverage": factor_coverage, "yearly_report": yearly_report, "drawdowns": drawdowns,
    "minute_daily": minute_daily, "intraday_risk": intraday_risk, "analyst_consensus": analyst_consensus, "concept_members": concept_members,
}
ORACLES = {
    "labels_registered": _labels_sql(), "factor_library": _factor_sql(), "risk_exposures": _exposure_sql(), "benchmarks": BENCHMARKS, "index_groups": INDEX_GROUPS, "signed_backtest": SIGNED, "exposure_report": EXPOSURE_REPORT,
    "industry_weights": INDUSTRIES, "factor_coverage": COVERAGE, "yearly_report": YEARLY, "drawdowns": DRAWDOWNS, "minute_daily": MINUTE_DAILY, "intraday_risk": INTRADAY_RISK, "analyst_consensus": CONSENSUS, "concept_members": CONCEPTS,
}
