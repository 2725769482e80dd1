"""Evaluation of a factor beyond its returns: benchmarks, masks, signs, index groups, exposures, industries, reports.

Rows are (trade_date, ts_code, ...) over a dense panel; all statistics combine
in partial aggregates by date before they move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.crosssection import Cross
from tessaly.functions.elementwise import all_of, finite
from tessaly.functions.timeseries import EPS

from .backtest import CODE, DATE, information_coefficients


def combined_mask(*masks: str) -> Column:
    """Where every mask column holds true."""
    return all_of([F.col(m) for m in masks])


def masked_weights(rows: DataFrame, weight: str, entry: str) -> DataFrame:
    """Names that can't be entered weigh 0; nothing is given to others in their place."""
    return rows.withColumn(weight, F.when(F.col(weight).isNotNull(), F.when(F.coalesce(F.col(entry), F.lit(False)), F.col(weight)).otherwise(F.lit(0.0))))


def market_benchmark(rows: DataFrame, label: str, signal: str, entry: str) -> DataFrame:
    """Mean label by date over names in the signal universe; names that can't be entered count in the number only."""
    r = F.when(F.coalesce(F.col(signal), F.lit(False)), finite(F.col(label)))
    return rows.groupBy(DATE).agg(F.when(F.count(r) > 0, F.sum(F.when(F.coalesce(F.col(entry), F.lit(False)), r).otherwise(F.when(r.isNotNull(), F.lit(0.0)))) / F.count(r)).alias("benchmark"))


def weighted_benchmark(rows: DataFrame, label: str, weight: str, entry: str) -> DataFrame:
    """The label's mean by positive index weights; names that can't be entered count in the weight only."""
    w, r = F.when(finite(F.col(weight)) > 0, F.col(weight)), finite(F.col(label))
    w = F.when(r.isNotNull(), w)
    return rows.groupBy(DATE).agg(F.when(F.sum(w) > EPS, F.sum(F.when(F.coalesce(F.col(entry), F.lit(False)), w * r).otherwise(w * 0)) / F.sum(w)).alias("benchmark"))


def group_portfolios(rows: DataFrame, factor: str, label: str, n: int, universe: str | None = None, entry: str | None = None) -> DataFrame:
    """Return by date and group (group_1 to group_n) of equal weights within the universe; blocked names weigh 0, missing labels count 0."""
    f = finite(F.col(factor)) if universe is None else F.when(F.coalesce(F.col(universe), F.lit(False)), finite(F.col(factor)))
    grouped = rows.withColumn("_f", f).withColumn("_g", Cross().groups(F.col("_f"), n)).filter("_g is not null")
    r = finite(F.col(label)) if entry is None else F.when(F.coalesce(F.col(entry), F.lit(False)), finite(F.col(label)))
    portfolio = F.concat(F.lit("group_"), (F.col("_g") + 1).cast("string")).alias("portfolio")
    return grouped.groupBy(DATE, portfolio).agg(F.count(F.lit(1)).alias("members"), F.when(F.count(r) > 0, F.sum(F.coalesce(r, F.lit(0.0))) / F.count(F.lit(1))).alias("ret"))


def with_excess(portfolios: DataFrame, benchmark: DataFrame) -> DataFrame:
    return portfolios.join(benchmark, DATE, "left").withColumn("excess", F.col("ret") - F.col("benchmark"))


def rank_ic_sign(rows: DataFrame, factor: str, label: str) -> DataFrame:
    """One row: -1 where the mean rank IC is negative, else 1."""
    return information_coefficients(rows, factor, label).agg(F.when(F.avg("rank_ic") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign"))


def signed_report(portfolios: DataFrame, sign: DataFrame, n: int) -> DataFrame:
    """Long-short returns (last group less first) turned by the sign, and which group is held long."""
    ends = portfolios.groupBy(DATE).agg(F.max(F.when(F.col("portfolio") == f"group_{n}", F.col("ret"))).alias("_high"), F.max(F.when(F.col("portfolio") == "group_1", F.col("ret"))).alias("_low"))
    both = ends.crossJoin(F.broadcast(sign))  # one row
    held = F.when(F.col("sign") < 0, F.lit("group_1")).otherwise(F.lit(f"group_{n}"))
    return both.select(DATE, "sign", ((F.col("_high") - F.col("_low")) * F.col("sign")).alias("long_short"), held.alias("long_group"), F.when(F.col("sign") < 0, F.col("_low")).otherwise(F.col("_high")).alias("long_ret"))


def _correlation(a: Column, b: Column) -> tuple[Column, Column]:
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    ok = (F.count(x) >= 2) & (F.var_pop(x) > EPS) & (F.var_pop(y) > EPS)
    return F.when(ok, F.covar_pop(x, y) / F.sqrt(F.var_pop(x)) / F.sqrt(F.var_pop(y))), F.count(x)


def exposure_ic(rows: DataFrame, factor: str, exposures: Sequence[str]) -> DataFrame:
    """(date, exposure, ic, pairs): the factor's correlation with each exposure by date."""
    cells = []
    for e in exposures:
        ic, n = _correlation(finite(F.col(factor)), finite(F.col(e)))
        cells += [ic.alias(f"_ic_{e}"), n.alias(f"_n_{e}")]
    wide = rows.groupBy(DATE).agg(*cells)
    return wide.select(DATE, F.explode(F.array(*[F.struct(F.lit(e).alias("exposure"), F.col(f"_ic_{e}").alias("ic"), F.col(f"_n_{e}").alias("pairs")) for e in exposures])).alias("r")).select(DATE, "r.*")


def weighted_exposure(rows: DataFrame, weight: str, exposures: Sequence[str]) -> DataFrame:
    """(date, exposure, value, pairs): each exposure's mean by the portfolio's weights, over names that hold both."""
    cells = []
    for e in exposures:
        v = finite(F.col(e))
        w = F.when((F.abs(F.col(weight)) > EPS) & v.isNotNull(), F.col(weight))
        cells += [F.when(F.abs(F.sum(w)) > EPS, F.sum(w * v) / F.sum(w)).alias(f"_v_{e}"), F.count(w).alias(f"_n_{e}")]
    wide = rows.groupBy(DATE).agg(*cells)
    return wide.select(DATE, F.explode(F.array(*[F.struct(F.lit(e).alias("exposure"), F.col(f"_v_{e}").alias("value"), F.col(f"_n_{e}").alias("pairs")) for e in exposures])).alias("r")).select(DATE, "r.*")


def industry_weights(rows: DataFrame, weight: str, industry: str) -> DataFrame:
    """A portfolio's weight and number of names by date and industry; names without one are `unknown`."""
    named = F.when(F.col(industry).isNull() | (F.col(industry) == ""), F.lit("unknown")).otherwise(F.col(industry))
    held = rows.filter(F.abs(F.col(weight)) > EPS)
    return held.groupBy(DATE, named.alias("industry")).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("names"))


def coverage(rows: DataFrame, factor: str, universe: str) -> DataFrame:
    """By date: names in the universe, with a value, with a finite one, with an infinite one, and the rates."""
    x, inside = F.col(factor), F.coalesce(F.col(universe), F.lit(False))
    infinite = inside & (F.abs(x) == float("inf"))
    n = F.count(F.when(inside, 1))
    rate = lambda c: F.when(n > 0, F.count(F.when(c, 1)) / n)
    return rows.groupBy(DATE).agg(n.alias("universe"), F.count(F.when(inside & x.isNotNull(), 1)).alias("present"), F.count(F.when(inside & finite(x).isNotNull(), 1)).alias("finite"), F.count(F.when(infinite, 1)).alias("infinite"), rate(inside & finite(x).isNotNull()).alias("coverage"), rate(infinite).alias("inf_rate"))


def report_by_year(returns: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days, mean, compounded return, deviation and share of gains by year and over all (year null)."""
    rows = returns.select(*keys, F.floor(F.col(DATE) / 10000).cast("int").alias("year"), finite(F.col(value)).alias("r")).filter("r is not null")
    sets = rows.withColumn("year", F.explode(F.array(F.col("year"), F.lit(None).cast("int"))))
    return sets.groupBy(*keys, "year").agg(F.count("r").alias("days"), F.avg("r").alias("mean"), (F.product(F.col("r") + 1) - 1).alias("compounded"), F.stddev_samp("r").alias("deviation"), F.avg((F.col("r") > 0).cast("double")).alias("gains"))


def drawdown_episodes(returns: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each stretch below a peak: peak date, date of the deepest point, end (null if still below), depth and length in sessions."""
    upto = Window.partitionBy(*keys).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*keys).orderBy(DATE)
    rows = returns.select(*keys, DATE, finite(F.col(value)).alias("r")).filter("r is not null")
    grown = rows.withColumn("nav", F.round(F.product(F.col("r") + 1).over(upto), 12))
    fallen = grown.withColumn("peak", F.max("nav").over(upto)).withColumn("down", F.col("nav") / F.col("peak") - 1).withColumn("next", F.lead(DATE).over(order))
    # a peak opens an episode; those in which nothing falls are left out
    marked = fallen.withColumn("episode", F.sum((F.col("nav") >= F.col("peak")).cast("int")).over(upto))
    by = marked.groupBy(*keys, "episode").agg(F.min(DATE).alias("peak_date"), F.min_by(DATE, F.struct("down", DATE)).alias("low_date"), F.min("down").alias("depth"), (F.count(F.lit(1)) - 1).alias("sessions"), F.max_by("next", DATE).alias("end_date"))
    return by.filter("sessions > 0").drop("episode")
