"""Minutes to days: aggregates of a day, risk of five-minute returns, and liquidity from sums that add up over days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.elementwise import finite
from tessaly.functions.timeseries import EPS

DATE, CODE = "trade_date", "ts_code"


def daily(rows: DataFrame, aggregates: dict[str, Column], start: int | None = None, end: int | None = None, minute: str = "minute") -> DataFrame:
    """One row a date and instrument of any aggregates over the minutes from `start` to `end`."""
    inside = rows if start is None else rows.filter(F.col(minute) >= start)
    inside = inside if end is None else inside.filter(F.col(minute) <= end)
    return inside.groupBy(DATE, CODE).agg(*[c.alias(n) for n, c in aggregates.items()])


def rolled(days: DataFrame, values: Sequence[str], n: int, least: int = 1) -> DataFrame:
    """Sums of daily sums over the last `n` rows of an instrument; null with fewer than `least` of them."""
    frame = Window.partitionBy(CODE).orderBy(DATE).rowsBetween(1 - n, 0)
    return days.withColumns({v: F.when(F.count(v).over(frame) >= least, F.sum(v).over(frame)) for v in values})


def log_returns(rows: DataFrame, price: str, minute: str = "minute") -> DataFrame:
    """Adds `r`, the log return from the bar before of the same day."""
    before = F.lag(price).over(Window.partitionBy(DATE, CODE).orderBy(minute))
    return rows.withColumn("r", F.when((F.col(price) > EPS) & (before > EPS), F.log(F.col(price) / before)))


def market_residuals(rows: DataFrame, r: str = "r", minute: str = "minute", least: int = 3) -> DataFrame:
    """Adds `residual`: the return less its line on the mean return of all instruments at that minute, by date and instrument."""
    market = rows.groupBy(DATE, minute).agg(F.avg(finite(F.col(r))).alias("market"))
    joined = rows.join(market, [DATE, minute])
    day = Window.partitionBy(DATE, CODE)
    both = F.col(r).isNotNull() & F.col("market").isNotNull()
    x, y = F.when(both, F.col("market")), F.when(both, F.col(r))
    slope = F.when(F.var_pop(x).over(day) > 1e-18, F.covar_pop(x, y).over(day) / F.var_pop(x).over(day))
    line = F.avg(y).over(day) + slope * (F.col("market") - F.avg(x).over(day))
    return joined.withColumn("residual", F.when(F.count(x).over(day) >= least, y - line))


def tail_risk(rows: DataFrame, value: str, share: float) -> DataFrame:
    """By date and instrument: realised variance, value at risk of both tails at `share`, and the mean beyond each (or at it)."""
    v = finite(F.col(value))
    cuts = rows.groupBy(DATE, CODE).agg(F.percentile(v, F.lit(share)).alias("_low"), F.percentile(v, F.lit(1 - share)).alias("_high"))
    joined = rows.join(cuts, [DATE, CODE])
    return joined.groupBy(DATE, CODE).agg(
        F.count(v).alias("n"), F.sum(v * v).alias("realised"), (-F.first("_low")).alias("var_left"), F.first("_high").alias("var_right"),
        (-F.avg(F.when(v <= F.col("_low"), v))).alias("cvar_left"), F.avg(F.when(v >= F.col("_high"), v)).alias("cvar_right"),
    )


def pair_sums(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The sums of a day from which covariance, slope and correlation of any span of days follow."""
    both = finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return rows.groupBy(DATE, CODE).agg(F.count(a).cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))


def restored(sums: DataFrame) -> DataFrame:
    """Covariance, slope of y on x and correlation from sums."""
    n = F.col("n")
    cov = F.when(n >= 2, F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n)
    vx, vy = F.col("sxx") / n - (F.col("sx") / n) ** 2, F.col("syy") / n - (F.col("sy") / n) ** 2
    return sums.select(DATE, CODE, cov.alias("covariance"), F.when(vx > 1e-12, cov / vx).alias("slope"), F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).alias("correlation"))
