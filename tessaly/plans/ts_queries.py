"""Queries on the rolling operators, over the monthly supplier panel: frames of 6 slots, at least 3 values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions.timeseries import Rolling, ewm
from tessaly.plans.panel import PANEL_SQL, trade_panel

N, M, HALF_LIFE = 6, 3, 2.0
R = Rolling(N, M)
KEYS = ["trade_date", "ts_code"]


def rounded(c):
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _query(columns):
    """A query of the columns that a function of x, y and z makes; columns need a session, so none is made on import."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = trade_panel(spark, sf_dir)
        return panel.select(*KEYS, *[rounded(c).alias(name) for name, c in columns(*map(F.col, "xyz")).items()])

    return run


def _sql(body: str, **columns: str) -> str:
    """SQL with windows `f` (the frame) and `o` (the order), rounded like the query."""
    chosen = ", ".join(f"round({c}, 6) + 0.0 as {name}" for name, c in columns.items())
    return f"with {PANEL_SQL}{body} select trade_date, ts_code, {chosen} from s"


_WINDOWS = f" window o as (partition by ts_code order by trade_date), f as (partition by ts_code order by trade_date rows between {N - 1} preceding and current row)"
_X = (
    ", s as (select *, case when n >= 3 then 1 end as ok from (select trade_date, ts_code, x, count(x) over f as n, sum(x) over f as su, avg(x) over f as me, max(x) over f as mx, min(x) over f as mn,"
    " stddev_pop(x) over f as sd, var_pop(x) over f as va, quantile_cont(x, 0.5) over f as md, quantile_cont(x, 0.2) over f as q2, product(x) over f as pr,"
    " lag(x, 2) over o as l2, list(x) over f as l from panel" + _WINDOWS + "))"
)
_HELD = "list_filter(l, lambda v: v is not null)"
_P = (
    ", t as (select trade_date, ts_code, x, y, z, list({'x': x, 'y': y, 'z': z}) over f as l from panel" + _WINDOWS + ")"
    ", s as (select *, list_filter(l, lambda v: v.x is not null and v.y is not null) as h from t)"
)


def _pair_sql(body: str, **columns: str) -> str:
    return f"with {PANEL_SQL}{_P}{body} select trade_date, ts_code, " + ", ".join(f"round({c}, 6) + 0.0 as {name}" for name, c in columns.items()) + " from r"


def _mean(f: str, of: str = "h") -> str:
    return f"list_avg(list_transform({of}, lambda v: {f}))"


_MOMENTS = (
    f", m as (select *, len(h) as n, {_mean('v.x')} as mx, {_mean('v.y')} as my from s)"
    ", r as (select *, list_avg(list_transform(h, lambda v: (v.x - mx) * (v.y - my))) as cxy, list_avg(list_transform(h, lambda v: (v.x - mx) ** 2)) as vx,"
    " list_avg(list_transform(h, lambda v: (v.y - my) ** 2)) as vy, list_avg(list_transform(h, lambda v: (v.y - my) * (v.x - mx) ** 2)) as c12,"
    " list_avg(list_transform(h, lambda v: (v.y - my) * (v.x - mx) ** 3)) as c13, list_avg(list_transform(h, lambda v: (v.y - my) ** 2 * (v.x - mx) ** 2)) as c22 from m)"
)

_EW = (
    f", e as (select *, len(l) as k from s), w as (select *, list_filter(list_transform(range(1, k + 1), lambda i: {{'w': (0.5 ** (1 / {HALF_LIFE})) ** (k - i), 'x': l[i].x, 'y': l[i].y}}), lambda v: v.x is not null) as hx,"
    f" list_filter(list_transform(range(1, k + 1), lambda i: {{'w': (0.5 ** (1 / {HALF_LIFE})) ** (k - i), 'x': l[i].x, 'y': l[i].y}}), lambda v: v.x is not null and v.y is not null) as hp from e),"
    " u as (select *, list_sum(list_transform(hx, lambda v: v.w)) as w1, list_sum(list_transform(hx, lambda v: v.w * v.x)) as x1, list_sum(list_transform(hx, lambda v: v.w * v.x * v.x)) as x2,"
    " list_sum(list_transform(hp, lambda v: v.w)) as pw, list_sum(list_transform(hp, lambda v: v.w * v.x)) as px, list_sum(list_transform(hp, lambda v: v.w * v.y)) as py,"
    " list_sum(list_transform(hp, lambda v: v.w * v.x * v.x)) as pxx, list_sum(list_transform(hp, lambda v: v.w * v.x * v.y)) as pxy, list_sum(list_transform(hp, lambda v: v.w * v.y * v.y)) as pyy from w),"
    " r as (select *, pxx - px * px / pw as sxx, pxy - px * py / pw as sxy, pyy - py * py / pw as syy from u)"
)

_RANKS = (
    ", k as (select *, len(h) as n, list_transform(h, lambda v: len(list_filter(h, lambda t: t.x < v.x)) + (len(list_filter(h, lambda t: t.x = v.x)) + 1) / 2 - (len(h) + 1) / 2) as a,"
    " list_transform(h, lambda v: len(list_filter(h, lambda t: t.y < v.y)) + (len(list_filter(h, lambda t: t.y = v.y)) + 1) / 2 - (len(h) + 1) / 2) as b from s),"
    " r as (select *, list_sum(list_transform(a, lambda v: v * v)) as aa, list_sum(list_transform(b, lambda v: v * v)) as bb, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) as ab from k)"
)

_SLOPES = ", r as (select *, len(h) as n, list_filter(flatten(list_transform(range(1, len(h) + 1), lambda i: list_transform(range(i + 1, len(h) + 1), lambda j: case when abs(h[j].x - h[i].x) > 2.3e-16 then (h[j].y - h[i].y) / (h[j].x - h[i].x) end))), lambda v: v is not null) as sl from s)"

_TRIPLE = (
    ", h3 as (select *, list_filter(l, lambda v: v.x is not null and v.y is not null and v.z is not null) as q from t)"
    f", m as (select *, len(q) as n, {_mean('v.x', 'q')} as mx, {_mean('v.y', 'q')} as my, {_mean('v.z', 'q')} as mz from h3)"
    ", v as (select *, list_avg(list_transform(q, lambda v: (v.x - mx) * (v.y - my))) as cxy, list_avg(list_transform(q, lambda v: (v.x - mx) * (v.z - mz))) as cxz, list_avg(list_transform(q, lambda v: (v.y - my) * (v.z - mz))) as cyz,"
    " sqrt(list_avg(list_transform(q, lambda v: (v.x - mx) ** 2))) as sx, sqrt(list_avg(list_transform(q, lambda v: (v.y - my) ** 2))) as sy, sqrt(list_avg(list_transform(q, lambda v: (v.z - mz) ** 2))) as sz from m)"
    ", r as (select *, case when sx * sy > 1e-12 then cxy / (sx * sy) end as rxy, case when sx * sz > 1e-12 then cxz / (sx * sz) end as rxz, case when sy * sz > 1e-12 then cyz / (sy * sz) end as ryz from v)"
)


def ts_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir).select(*KEYS, "x")
    return ewm(panel, "x", 4, M).select(*KEYS, rounded(F.col("ewm")).alias("ewm"))


QUERIES = {
    "ts_moments": _query(lambda x, y, z: dict(ts_sum=R.sum(x), ts_mean=R.mean(x), ts_max=R.max(x), ts_min=R.min(x), ts_prod=R.prod(x), ts_std_dev=R.std_dev(x), ts_variance=R.variance(x))),
    "ts_quantiles": _query(lambda x, y, z: dict(ts_median=R.median(x), ts_quantile=R.quantile(x, 0.2), ts_diff_median=R.diff_median(x))),
    "ts_shape": _query(lambda x, y, z: dict(ts_skew=R.skew(x), ts_kurt=R.kurt(x), ts_central_moment=R.central_moment(x, 3), ts_entropy=R.entropy(x))),
    "ts_ratios": _query(lambda x, y, z: dict(ts_cv=R.cv(x), ts_ir=R.ir(x), ts_zscore=R.zscore(x))),
    "ts_minmax": _query(lambda x, y, z: dict(ts_minmax_scale=R.minmax_scale(x), ts_minmax_cps=R.minmax_cps(x), ts_minmax_diff=R.minmax_diff(x), ts_diff_avg=R.diff_avg(x), ts_diff_max=R.diff_max(x), ts_diff_min=R.diff_min(x))),
    "ts_shifts": _query(lambda x, y, z: dict(ts_delay=R.delay(x, 2), ts_diff=R.diff(x, 2), ts_pctchg=R.pctchg(x, 2), ts_pctchg_abs=R.pctchg_abs(x, 2))),
    "ts_places": _query(lambda x, y, z: dict(ts_argmax=R.argmax(x), ts_argmin=R.argmin(x), ts_decay_linear=R.decay_linear(x), ts_rank=R.rank(x), ts_pctrank=R.pctrank(x))),
    "ts_exponential": _query(lambda x, y, z: dict(ts_ew_sum=R.ew_sum(x, HALF_LIFE), ts_ew_std_dev=R.ew_std_dev(x, HALF_LIFE), **{f"ew_{f}": R.ew_regression(y, x, HALF_LIFE)[f] for f in ("alpha", "beta", "residual_sigma")})),
    "ts_ewm": ts_ewm,
    "ts_pairs": _query(lambda x, y, z: dict(ts_covariance=R.covariance(x, y), ts_corr=R.corr(x, y), ts_regression=R.regression(y, x))),
    "ts_co_moments": _query(lambda x, y, z: dict(ts_coskew_yxx=R.coskew_yxx(y, x), ts_co_kurt_yxxx=R.co_kurt_yxxx(y, x), ts_co_kurt_yyxx=R.co_kurt_yyxx(y, x))),
    "ts_partial_corr": _query(lambda x, y, z: dict(ts_partial_corr_xy_z=R.partial_corr_xy_z(x, y, z))),
    "ts_rankcorr": _query(lambda x, y, z: dict(ts_rankcorr=R.rankcorr(x, y))),
    "ts_theilsen": _query(lambda x, y, z: dict(ts_theilsen=R.theilsen(y, x))),
}

ORACLES = {
    "ts_moments": _sql(_X, ts_sum="su * ok", ts_mean="me * ok", ts_max="mx * ok", ts_min="mn * ok", ts_prod="pr * ok", ts_std_dev="sd * ok", ts_variance="va * ok"),
    "ts_quantiles": _sql(_X, ts_median="md * ok", ts_quantile="q2 * ok", ts_diff_median="(x - md) * ok"),
    "ts_shape": _sql(
        _X,
        ts_skew=f"case when sd > 1e-12 then list_avg(list_transform({_HELD}, lambda v: (v - me) ** 3)) / sd ** 3 * ok end",
        ts_kurt=f"case when sd > 1e-12 then list_avg(list_transform({_HELD}, lambda v: (v - me) ** 4)) / sd ** 4 * ok end",
        ts_central_moment=f"list_avg(list_transform({_HELD}, lambda v: (v - me) ** 3)) * ok",
        ts_entropy=f"case when su > 1e-12 then list_sum(list_transform(list_filter({_HELD}, lambda v: abs(v) > 0), lambda v: -abs(v) / su * ln(abs(v) / su))) * ok end",
    ),
    "ts_ratios": _sql(_X, ts_cv="case when abs(me) > 1e-12 then sd / me * ok end", ts_ir="case when sd > 1e-12 then me / sd * ok end", ts_zscore="case when sd > 1e-12 then (x - me) / sd * ok end"),
    "ts_minmax": _sql(
        _X, ts_minmax_scale="case when mx > mn then (x - mn) / (mx - mn) * ok end", ts_minmax_cps="case when mx > mn then (2 * (x - mn) / (mx - mn) - 1) * ok end", ts_minmax_diff="(mx - mn) * ok",
        ts_diff_avg="(x - me) * ok", ts_diff_max="(x - mx) * ok", ts_diff_min="(x - mn) * ok",
    ),
    "ts_shifts": _sql(_X, ts_delay="l2", ts_diff="x - l2", ts_pctchg="case when abs(l2) > 1e-12 then x / l2 - 1 end", ts_pctchg_abs="case when abs(l2) > 1e-12 then abs(x / l2 - 1) end"),
    "ts_places": _sql(
        _X, ts_argmax="(list_position(l, mx) - 1) * ok", ts_argmin="(list_position(l, mn) - 1) * ok",
        ts_decay_linear="list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * i)) / list_sum(list_transform(range(1, len(l) + 1), lambda i: case when l[i] is not null then i end)) * ok",
        ts_rank=f"(len(list_filter({_HELD}, lambda v: v < {_HELD}[-1])) + (len(list_filter({_HELD}, lambda v: v = {_HELD}[-1])) + 1) / 2) * ok",
        ts_pctrank=f"(len(list_filter({_HELD}, lambda v: v < {_HELD}[-1])) + (len(list_filter({_HELD}, lambda v: v = {_HELD}[-1])) + 1) / 2 - 1) / (n - 1) * ok",
    ),
    "ts_exponential": _pair_sql(
        _EW, ts_ew_sum="case when len(hx) >= 3 then x1 end", ts_ew_std_dev="case when len(hx) >= 3 then sqrt(greatest((x2 - x1 * x1 / w1) / w1, 0)) end",
        ew_alpha="case when len(hp) >= 3 and sxx > 1e-12 then py / pw - sxy / sxx * px / pw end", ew_beta="case when len(hp) >= 3 and sxx > 1e-12 then sxy / sxx end",
        ew_residual_sigma="case when len(hp) >= 3 and sxx > 1e-12 then sqrt(greatest((syy - sxy / sxx * sxy) / pw, 0)) end",
    ),
    "ts_ewm": f"with {PANEL_SQL}, s as (select trade_date, ts_code, x, list_filter(list(x) over (partition by ts_code order by trade_date), lambda v: v is not null) as l from panel) select trade_date, ts_code, round(case when x is not null and len(l) >= 3 then list_reduce(l, lambda a, b: 0.4 * b + 0.6 * a) end, 6) + 0.0 as ewm from s",
    "ts_pairs": _pair_sql(
        _MOMENTS, ts_covariance="case when n >= 3 then cxy end", ts_corr="case when n >= 3 and sqrt(vx) * sqrt(vy) > 1e-12 then cxy / (sqrt(vx) * sqrt(vy)) end", ts_regression="case when n >= 3 and vx > 1e-12 then cxy / vx end"
    ),
    "ts_co_moments": _pair_sql(
        _MOMENTS, ts_coskew_yxx="case when n >= 3 and vx > 1e-12 and vy > 1e-12 then c12 / (sqrt(vy) * vx) end", ts_co_kurt_yxxx="case when n >= 3 and vx > 1e-12 and vy > 1e-12 then c13 / (sqrt(vy) * vx * sqrt(vx)) end",
        ts_co_kurt_yyxx="case when n >= 3 and vx > 1e-12 and vy > 1e-12 then c22 / (vy * vx) end",
    ),
    "ts_partial_corr": _pair_sql(_TRIPLE, ts_partial_corr_xy_z="case when n >= 3 and (1 - rxz * rxz) * (1 - ryz * ryz) > 1e-20 then (rxy - rxz * ryz) / sqrt((1 - rxz * rxz) * (1 - ryz * ryz)) end"),
    "ts_rankcorr": _pair_sql(_RANKS, ts_rankcorr="case when n >= 3 and aa * bb > 1e-12 then ab / sqrt(aa * bb) end"),
    "ts_theilsen": _pair_sql(_SLOPES, ts_theilsen="case when n >= 3 and len(sl) > 0 then list_aggregate(sl, 'median') end"),
}
