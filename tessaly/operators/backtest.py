"""Cross-sectional backtests: labels, groups, weights, information coefficients, portfolio returns and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.crosssection import Cross
from tessaly.functions.timeseries import EPS

DATE, CODE = "trade_date", "ts_code"


def finite(x: Column) -> Column:
    """Null for anything that isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def forward_return(price: Column, k: int) -> Column:
    """price[t + k + 1] / price[t + 1] - 1 over the dense axis: a signal of t trades on t + 1."""
    order = Window.partitionBy(CODE).orderBy(DATE)
    entry = F.lead(price, 1).over(order)
    return F.when(F.abs(entry) > EPS, F.lead(price, k + 1).over(order) / entry - 1)


def information_coefficients(rows: DataFrame, factor: str, label: str) -> DataFrame:
    """Pearson and rank correlation by date; ranks are taken before pairing, and at least two pairs must differ."""
    ranked = rows.select(DATE, CODE, finite(F.col(factor)).alias("f"), finite(F.col(label)).alias("r"))
    d = Cross()
    ranked = ranked.select("*", d.pctrank(F.col("f")).alias("pf"), d.pctrank(F.col("r")).alias("pr"))

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.when((F.count(x) >= 2) & (F.var_pop(x) > EPS) & (F.var_pop(y) > EPS), F.covar_pop(x, y) / F.sqrt(F.var_pop(x)) / F.sqrt(F.var_pop(y)))

    return ranked.groupBy(DATE).agg(corr("f", "r").alias("ic"), corr("pf", "pr").alias("rank_ic"))


def ic_decay(rows: DataFrame, factor: str, label: str, horizons: Sequence[int]) -> DataFrame:
    """Mean Pearson IC by horizon: the one-day label of h - 1 dates later."""
    order = Window.partitionBy(CODE).orderBy(DATE)
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(F.col(label), h - 1).over(order).alias("later")) for h in horizons])
    lagged = rows.select(DATE, CODE, F.col(factor), later.alias("all")).select(DATE, CODE, F.col(factor), F.explode("all").alias("_h"))
    both = finite(F.col(factor)).isNotNull() & finite(F.col("_h.later")).isNotNull()
    a, b = F.when(both, F.col(factor)), F.when(both, F.col("_h.later"))
    ic = F.when((F.count(a) >= 2) & (F.var_pop(a) > EPS) & (F.var_pop(b) > EPS), F.covar_pop(a, b) / F.sqrt(F.var_pop(a)) / F.sqrt(F.var_pop(b)))
    return lagged.groupBy(F.col("_h.horizon").alias("horizon"), DATE).agg(ic.alias("ic")).groupBy("horizon").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("dates"))


def weighted(rows: DataFrame, factor: str) -> DataFrame:
    """Adds `weight`: the date's percent ranks less their mean, over the sum of their distances, so longs and shorts are half each."""
    d = Window.partitionBy(DATE)
    ranked = rows.withColumn("_p", Cross().pctrank(finite(F.col(factor))))
    centred = ranked.withColumn("_c", F.col("_p") - F.avg("_p").over(d))
    total = F.sum(F.abs("_c")).over(d)
    return centred.withColumn("weight", F.when(total > EPS, F.col("_c") / total)).drop("_p", "_c")


def group_returns(rows: DataFrame, factor: str, label: str, n: int) -> DataFrame:
    """Mean label by date and group of equal counts; a missing label counts 0, a group without any has null."""
    grouped = rows.withColumn("grp_no", Cross().groups(finite(F.col(factor)), n)).filter(F.col("grp_no").isNotNull())
    r = finite(F.col(label))
    return grouped.groupBy(DATE, "grp_no").agg(F.count(F.lit(1)).alias("members"), F.when(F.count(r) > 0, F.sum(F.coalesce(r, F.lit(0.0))) / F.count(F.lit(1))).alias("ret"))


def portfolio(rows: DataFrame, label: str) -> DataFrame:
    """Return and turnover by date from `weight`: missing labels count 0, weights aren't scaled again; turnover is half the sum of changes."""
    order = Window.partitionBy(CODE).orderBy(DATE)
    w, r = F.coalesce(F.col("weight"), F.lit(0.0)), finite(F.col(label))
    changed = rows.withColumn("_d", F.abs(w - F.coalesce(F.lag(w).over(order), F.lit(0.0)))).withColumn("_first", F.lag(F.lit(1)).over(order).isNull())
    return changed.groupBy(DATE).agg(
        F.when(F.count(F.when(F.col("weight").isNotNull(), r)) > 0, F.sum(F.coalesce(F.col("weight") * r, F.lit(0.0)))).alias("ret"),
        F.when(~F.bool_and("_first"), F.sum("_d") / 2).alias("turnover"),
    )


def held_weights(rows: DataFrame, rebalance: DataFrame) -> DataFrame:
    """`weight` carried forward from the last date in `rebalance`; before the first there is none."""
    marked = rows.join(F.broadcast(rebalance.select(DATE).distinct().withColumn("_turn", F.lit(True))), DATE, "left")  # a calendar
    order = Window.partitionBy(CODE).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.when(F.col("_turn"), F.struct(F.col("weight").alias("w"))), ignorenulls=True).over(order)
    return marked.withColumn("weight", kept["w"]).drop("_turn")


def factor_stats(rows: DataFrame, factor: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest by date, and the share of instruments with a value."""
    x = finite(F.col(factor))
    return rows.groupBy(DATE).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.percentile(x, F.lit(0.25)).alias("p25"),
        F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.75)).alias("p75"), F.max(x).alias("max"), (F.count(x) / F.count(F.lit(1))).alias("coverage"),
    )


def summarised_stats(stats: DataFrame) -> DataFrame:
    """Means of daily statistics over all dates and by year, as grouping sets."""
    rows = stats.withColumn("year", F.floor(F.col(DATE) / 10000).cast("int"))
    return rows.rollup("year").agg(F.count(F.lit(1)).alias("dates"), F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.avg("coverage").alias("coverage"))


def return_metrics(returns: DataFrame, value: str = "ret", periods: int = 240, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of a return series by key: cumulative and annual return, volatility, Sharpe, Sortino, deepest drawdown, Calmar, win rate.

    Deviations are of the sample; Sortino's is that of negative returns; the
    drawdown's peak is the highest value so far, not the start.
    """
    keys = list(keys)
    rows = returns.select(*keys, DATE, finite(F.col(value)).alias("r")).filter(F.col("r").isNotNull())
    upto = Window.partitionBy(*keys).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("nav", F.product(F.col("r") + 1).over(upto))
    fallen = grown.withColumn("down", F.col("nav") / F.max("nav").over(upto) - 1)
    agg = fallen.groupBy(*keys).agg(
        F.count("r").alias("n"), (F.product(F.col("r") + 1) - 1).alias("cumulative"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("_neg"),
        F.min("down").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
    )
    scale = periods**0.5
    annual = F.when(F.col("cumulative") > -1, F.pow(F.col("cumulative") + 1, F.lit(float(periods)) / F.col("n")) - 1)
    over = lambda a, b: F.when(F.abs(b) > EPS, a / b)
    return (
        agg.withColumn("annual", annual)
        .withColumn("volatility", F.col("_s") * scale)
        .withColumn("sharpe", over(F.col("_m") * scale, F.col("_s")))
        .withColumn("sortino", over(F.col("_m") * scale, F.col("_neg")))
        .withColumn("calmar", over(F.col("annual"), F.abs("max_drawdown")))
        .select(*keys, "n", "cumulative", "annual", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate")
    )
