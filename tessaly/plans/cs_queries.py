"""Queries on the cross-sectional operators, over the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions.crosssection import Cross
from tessaly.operators.neutralize import residualise
from tessaly.plans.panel import PANEL_SQL, trade_panel
from tessaly.plans.ts_queries import KEYS, rounded

D = Cross()
G = D.by("grp")


def _query(columns):
    """A query of the columns that a function of x, y and z makes; columns need a session, so none is made on import."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = trade_panel(spark, sf_dir)
        return panel.select(*KEYS, *[rounded(c).alias(name) for name, c in columns(*map(F.col, "xyz")).items()])

    return run


def _sql(**columns: str) -> str:
    chosen = ", ".join(f"round({c}, 6) + 0.0 as {name}" for name, c in columns.items())
    return f"with {PANEL_SQL}, p as (select * from panel) select trade_date, ts_code, {chosen} from p window d as (partition by trade_date), g as (partition by trade_date, grp)"


def _grouped(value: str) -> str:
    return f"case when grp is not null and grp <> '' then {value} end"


def _rank(value: str, keys: str = "trade_date", order: str = "asc", extra: str = "") -> tuple[str, str]:
    part = f"partition by {keys}, {value} is null{extra}"
    return f"row_number() over ({part} order by {value} {order}, ts_code)", f"count({value}) over ({part})"


def _pct(value: str, keys: str = "trade_date", extra: str = "", order: str = "asc") -> str:
    rank, n = _rank(value, keys, order, extra)
    return f"(case when {value} is not null and {n} > 1 then ({rank} - 1) / ({n} - 1) end)"


def by_side(middle):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.col("x")
        panel = trade_panel(spark, sf_dir).withColumn("mean", F.round(D.mean(x), 9)).withColumn("median", F.round(D.median(x), 9))  # sums differ in the last bits between engines
        return panel.select(*KEYS, *[rounded(c).alias(n) for n, c in middle(x).items()])

    return run


def neutralised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted regression residuals on two regressors, plain and within groups, in closed form."""
    panel = trade_panel(spark, sf_dir).withColumn("x2", F.col("x")).withColumn("z2", F.col("z"))
    plain = residualise(panel, "y", ["x2", "z2"], out="resid")
    both = residualise(plain, "y", ["x2", "z2"], group="grp", weight="w", out="resid_by_group")
    return both.select(*KEYS, rounded(F.col("resid")).alias("resid"), rounded(F.col("resid_by_group")).alias("resid_by_group"))


def size_sector_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regressor within groups, then missing values filled with 0 where the size is there and the group has a residual."""
    panel = residualise(trade_panel(spark, sf_dir), "y", ["x"], group="grp", out="resid")
    any_resid = F.count("resid").over(G.rows)
    usable = F.col("grp").isNotNull() & (F.col("grp") != "") & F.col("x").isNotNull() & (any_resid > 0)
    return panel.select(*KEYS, rounded(F.col("resid")).alias("resid"), rounded(F.coalesce("resid", F.when(usable, F.lit(0.0)))).alias("resid_filled"))


QUERIES = {
    "cs_aggregates": _query(lambda x, y, z: dict(cs_sum=D.sum(x), cs_mean=D.mean(x), cs_max=D.max(x), cs_min=D.min(x), cs_std_dev=D.std_dev(x), cs_median=D.median(x))),
    "cs_centre": _query(lambda x, y, z: dict(cs_demean=D.demean(x), cs_demean_abs=D.demean_abs(x), cs_demean_by_group=G.demean(x), cs_neutralize=G.neutralize(x), cs_demedian_by_group=G.demedian(x), cs_dequantile_by_group=G.dequantile(x, 0.3))),
    "cs_fill": _query(lambda x, y, z: dict(cs_fill_mean_by_group=G.fill_mean(x), cs_fill_max_by_group=G.fill_max(x), cs_fill_min_by_group=G.fill_min(x), cs_fill_median_by_group=G.fill_median(x), cs_fill_quantile_by_group=G.fill_quantile(x, 0.3))),
    "cs_scales": _query(lambda x, y, z: dict(cs_minmax_scale=D.minmax_scale(x), cs_scale=D.scale(x), cs_zscore=D.zscore(x), cs_zscore_abs=D.zscore_abs(x), cs_zscore_by_group=G.zscore(x), cs_nonnegative=D.nonnegative(x), cs_nonpositive=D.nonpositive(x))),
    "cs_winsorize": _query(lambda x, y, z: dict(cs_winsorize_quantile=D.winsorize_quantile(x, 0.05, 0.9), cs_winsorize=D.winsorize(x, 0.8), cs_winsorize95=D.winsorize95(x))),
    "cs_ranks": _query(lambda x, y, z: dict(cs_rank=D.rank(x), cs_rank_desc=D.rank(x, False), cs_pctrank=D.pctrank(x), cs_pctrank_by_group=G.pctrank(x), cs_rank_by_sign=D.rank_by_sign(x - 0.5))),
    "cs_rank_sides": by_side(lambda x: {"cs_rank_by_meanside": D.rank_by_side(x, F.col("mean")), "cs_rank_by_medianside": D.rank_by_side(x, F.col("median"))}),
    "cs_rank_pairs": _query(lambda x, y, z: dict(cs_rank_y_add_x=D.rank_y_add_x(y, x), cs_rank_y_sub_x=D.rank_y_sub_x(y, x), cs_rank_y_mul_x=D.rank_y_mul_x(y, x), cs_rank_y_div_x=D.rank_y_div_x(y, x))),
    "cs_regression": _query(lambda x, y, z: dict(cs_regression_residual=D.regression_residual(y, x), cs_regression_residual_by_group=G.regression_residual(y, x))),
    "cs_gaussian_rank": _query(lambda x, y, z: dict(gaussian_rank=D.gaussian_rank(x))),
    "cs_neutralize_regression": neutralised,
    "cs_size_sector_neutral": size_sector_neutral,
}

_SIDES = (
    f"with {PANEL_SQL}, m as (select *, round(avg(x) over d, 9) as mean, round(quantile_cont(x, 0.5) over d, 9) as median from panel window d as (partition by trade_date)), p as (select *, sign(x - mean) as s1, sign(x - median) as s2 from m) "
    f"select trade_date, ts_code, round(case when s1 <> 0 then {_pct('x', extra=', s1')} end, 6) + 0.0 as cs_rank_by_meanside, round(case when s2 <> 0 then {_pct('x', extra=', s2')} end, 6) + 0.0 as cs_rank_by_medianside from p"
)

_RESIDUAL = "case when v is not null and {n} >= 2 then yy - avg(yy) over {w} - case when var_pop(v) over {w} > 1e-12 then covar_pop(yy, v) over {w} / var_pop(v) over {w} else 0 end * (v - avg(v) over {w}) end"

_TWO = """
, c as (select *, case when y is not null and x is not null and z is not null then 1.0 end as k from panel),
 d1 as (select *, y * k - avg(y * k) over d as a, x * k - avg(x * k) over d as b, z * k - avg(z * k) over d as e, count(k) over d as n from c window d as (partition by trade_date)),
 s1 as (select *, sum(b * b) over d as bb, sum(e * e) over d as ee, sum(b * e) over d as be, sum(a * b) over d as ab, sum(a * e) over d as ae from d1 window d as (partition by trade_date)),
 r1 as (select *, case when n >= 4 and abs(bb * ee - be * be) > 1e-12 then a - b * (ab * ee - ae * be) / (bb * ee - be * be) - e * (ae * bb - ab * be) / (bb * ee - be * be) end as resid from s1),
 c2 as (select *, case when k = 1 and w > 0 and grp is not null and grp <> '' then w::double end as q from r1),
 d2 as (select *, y - sum(q * y) over g / sum(q) over g as a2, x - sum(q * x) over g / sum(q) over g as b2, z - sum(q * z) over g / sum(q) over g as e2, count(q) over d as n2 from c2 window g as (partition by trade_date, grp), d as (partition by trade_date)),
 s2 as (select *, sum(q * b2 * b2) over d as bb2, sum(q * e2 * e2) over d as ee2, sum(q * b2 * e2) over d as be2, sum(q * a2 * b2) over d as ab2, sum(q * a2 * e2) over d as ae2 from d2 window d as (partition by trade_date))
select trade_date, ts_code, round(resid, 6) + 0.0 as resid,
 round(case when q is not null and n2 >= 3 and abs(bb2 * ee2 - be2 * be2) > 1e-12 then a2 - b2 * (ab2 * ee2 - ae2 * be2) / (bb2 * ee2 - be2 * be2) - e2 * (ae2 * bb2 - ab2 * be2) / (bb2 * ee2 - be2 * be2) end, 6) + 0.0 as resid_by_group from s2
"""

_ONE = """
, c as (select *, case when y is not null and x is not null and grp is not null and grp <> '' then 1.0 end as k from panel),
 d1 as (select *, y * k - avg(y * k) over g as a, x * k - avg(x * k) over g as b, count(k) over d as n from c window g as (partition by trade_date, grp), d as (partition by trade_date)),
 s1 as (select *, sum(b * b) over d as bb, sum(a * b) over d as ab from d1 window d as (partition by trade_date)),
 r1 as (select *, case when k = 1 and n >= 2 and bb > 1e-12 then a - b * ab / bb end as resid from s1),
 f1 as (select *, count(resid) over (partition by trade_date, grp) as m from r1)
select trade_date, ts_code, round(resid, 6) + 0.0 as resid, round(coalesce(resid, case when grp is not null and grp <> '' and x is not null and m > 0 then 0.0 end), 6) + 0.0 as resid_filled from f1
"""

_NORMAL = """
, k as (select *, row_number() over (partition by trade_date, x is null order by x, ts_code) as r, count(x) over (partition by trade_date, x is null) as n from panel),
 q as (select *, case when x is not null then least(greatest((r - 0.5) / n, 1e-6), 1 - 1e-6) end as p from k),
 t as (select *, p - 0.5 as u, (p - 0.5) * (p - 0.5) as v, sqrt(-2 * ln(least(p, 1 - p))) as s from q)
select trade_date, ts_code, round(case when p is null then null when p < 0.02425 or p > 0.97575 then
  case when p < 0.5 then 1 else -1 end * (((((-7.784894002430293e-03 * s - 3.223964580411365e-01) * s - 2.400758277161838e00) * s - 2.549732539343734e00) * s + 4.374664141464968e00) * s + 2.938163982698783e00)
    / ((((7.784695709041462e-03 * s + 3.224671290700398e-01) * s + 2.445134137142996e00) * s + 3.754408661907416e00) * s + 1)
  else (((((-3.969683028665376e01 * v + 2.209460984245205e02) * v - 2.759285104469687e02) * v + 1.383577518672690e02) * v - 3.066479806614716e01) * v + 2.506628277459239e00) * u
    / (((((-5.447609879822406e01 * v + 1.615858368580409e02) * v - 1.556989798598866e02) * v + 6.680131188771972e01) * v - 1.328068155288572e01) * v + 1) end, 6) + 0.0 as gaussian_rank from t
"""

ORACLES = {
    "cs_aggregates": _sql(cs_sum="sum(x) over d", cs_mean="avg(x) over d", cs_max="max(x) over d", cs_min="min(x) over d", cs_std_dev="stddev_pop(x) over d", cs_median="quantile_cont(x, 0.5) over d"),
    "cs_centre": _sql(
        cs_demean="x - avg(x) over d", cs_demean_abs="abs(x - avg(x) over d)", cs_demean_by_group=_grouped("x - avg(x) over g"), cs_neutralize=_grouped("x - avg(x) over g"),
        cs_demedian_by_group=_grouped("x - quantile_cont(x, 0.5) over g"), cs_dequantile_by_group=_grouped("x - quantile_cont(x, 0.3) over g"),
    ),
    "cs_fill": _sql(**{f"cs_fill_{n}_by_group": f"coalesce(x, {_grouped(f)})" for n, f in (("mean", "avg(x) over g"), ("max", "max(x) over g"), ("min", "min(x) over g"), ("median", "quantile_cont(x, 0.5) over g"), ("quantile", "quantile_cont(x, 0.3) over g"))}),
    "cs_scales": _sql(
        cs_minmax_scale="case when max(x) over d > min(x) over d then (x - min(x) over d) / (max(x) over d - min(x) over d) end", cs_scale="case when sum(abs(x)) over d > 1e-12 then x / sum(abs(x)) over d end",
        cs_zscore="case when stddev_pop(x) over d > 1e-12 then (x - avg(x) over d) / stddev_pop(x) over d end", cs_zscore_abs="case when stddev_pop(x) over d > 1e-12 then abs(x - avg(x) over d) / stddev_pop(x) over d end",
        cs_zscore_by_group=_grouped("case when stddev_pop(x) over g > 1e-12 then (x - avg(x) over g) / stddev_pop(x) over g end"),
        cs_nonnegative="case when stddev_pop(x) over d > 1e-12 then (x - min(x) over d) / stddev_pop(x) over d end", cs_nonpositive="case when stddev_pop(x) over d > 1e-12 then (x - max(x) over d) / stddev_pop(x) over d end",
    ),
    "cs_winsorize": _sql(
        cs_winsorize_quantile="case when x is not null then least(greatest(x, quantile_cont(x, 0.05) over d), quantile_cont(x, 0.9) over d) end",
        cs_winsorize="case when x is not null then least(x, quantile_cont(x, 0.8) over d) end", cs_winsorize95="case when x is not null then least(x, quantile_cont(x, 0.95) over d) end",
    ),
    "cs_ranks": _sql(
        cs_rank=f"case when x is not null then {_rank('x')[0]} end", cs_rank_desc=f"case when x is not null then {_rank('x', order='desc')[0]} end", cs_pctrank=_pct("x"),
        cs_pctrank_by_group=_grouped(_pct("x", "trade_date, grp")), cs_rank_by_sign=f"case when x <> 0.5 then {_pct('x', extra=', sign(x - 0.5)')} end",
    ),
    "cs_rank_sides": _SIDES,
    "cs_rank_pairs": _sql(
        cs_rank_y_add_x=f"{_pct('y')} + {_pct('x')}", cs_rank_y_sub_x=f"{_pct('y')} - {_pct('x')}", cs_rank_y_mul_x=f"{_pct('y')} * {_pct('x')}", cs_rank_y_div_x=f"case when {_pct('x')} > 1e-12 then {_pct('y')} / {_pct('x')} end"
    ),
    "cs_regression": f"with {PANEL_SQL}, p as (select *, case when x is not null and y is not null then x end as v, case when x is not null and y is not null then y end as yy from panel) select trade_date, ts_code, round("
    + _RESIDUAL.format(n="count(v) over d", w="d") + ", 6) + 0.0 as cs_regression_residual, round(" + _grouped(_RESIDUAL.format(n="count(v) over g", w="g"))
    + ", 6) + 0.0 as cs_regression_residual_by_group from p window d as (partition by trade_date), g as (partition by trade_date, grp)",
    "cs_gaussian_rank": f"with {PANEL_SQL}{_NORMAL}",
    "cs_neutralize_regression": f"with {PANEL_SQL}{_TWO}",
    "cs_size_sector_neutral": f"with {PANEL_SQL}{_ONE}",
}
