"""Futures minutes: main contracts' rows, prices stitched over rolls, forward labels, tails and holding backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.elementwise import finite
from tessaly.functions.timeseries import EPS

DATE = "trade_date"


def main_minutes(rows: DataFrame, mapping: DataFrame, code: str = "ts_code", main: str = "main", product: str = "product") -> DataFrame:
    """The minutes of each date's main contracts, with their product; an equality on date and contract."""
    return rows.join(mapping.select(DATE, F.col(main).alias(code), product), [DATE, code])


def stitched(rows: DataFrame, prices: Sequence[str], product: str = "product", code: str = "ts_code", order: str = "trade_time", close: str = "close", open_: str = "open") -> DataFrame:
    """Prices scaled so that a product's series goes on over a change of contract: by the last close over the first open there, so far.

    A boundary whose prices aren't positive leaves the scale as it is.
    """
    own = Window.partitionBy(product).orderBy(DATE, order)
    last = F.lag(F.struct(F.col(code).alias("c"), F.col(close).alias("p"))).over(own)
    rolled = last["c"].isNotNull() & (last["c"] != F.col(code)) & (last["p"] > 0) & (F.col(open_) > 0)
    marked = rows.withColumn("_step", F.when(rolled, F.log(last["p"] / F.col(open_))).otherwise(F.lit(0.0)))
    marked = marked.withColumn("scale", F.exp(F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0))))
    return marked.withColumns({p: F.col(p) * F.col("scale") for p in prices}).drop("_step")


def forward_minutes(open_: str, n: int, code: str = "ts_code", order: str = "trade_time") -> Column:
    """Basis points from the next bar's open to the open of `n` bars after it, within the contract's day; null where the first is about zero."""
    day = Window.partitionBy(DATE, code).orderBy(order)
    start = F.lead(open_, 1).over(day)
    return F.when(F.abs(start) > EPS, finite((F.lead(open_, n + 1).over(day) / start - 1) * 1e4))


#: Lengths of the registered minute labels.
MINUTE_LABELS = (1, 5, 15, 30)


def minute_labels(rows: DataFrame, open_: str = "open", lengths: Sequence[int] = MINUTE_LABELS, code: str = "ts_code", order: str = "trade_time") -> DataFrame:
    return rows.withColumns({f"future_open_return_{n}m": forward_minutes(open_, n, code, order) for n in lengths})


def tail_thresholds(rows: DataFrame, factor: str, share: float, sessions: int = 1, product: str = "product") -> DataFrame:
    """(date, product, lower, upper): the factor's quantiles over the product's last `sessions` dates, that date included.

    A row is sent to each date whose window holds it, so a date and product is
    one aggregate however long the window is.
    """
    dates = rows.select(product, DATE).distinct()
    ahead = Window.partitionBy(product).orderBy(DATE).rowsBetween(0, sessions - 1)
    reach = dates.withColumn("_ahead", F.collect_list(DATE).over(ahead)).select(product, DATE, F.explode("_ahead").alias("_to"))
    sent = rows.select(product, DATE, finite(F.col(factor)).alias("_f")).join(reach, [product, DATE])
    return sent.groupBy(F.col("_to").alias(DATE), product).agg(F.percentile("_f", F.lit(share)).alias("lower"), F.percentile("_f", F.lit(1 - share)).alias("upper"))


def tail_report(rows: DataFrame, factor: str, label: str, thresholds: DataFrame, product: str = "product") -> DataFrame:
    """By date and product: mean label and number of minutes above the upper and below the lower threshold, and the cosine of factor and label."""
    f, r = finite(F.col(factor)), finite(F.col(label))
    both = f.isNotNull() & r.isNotNull()
    x, y = F.when(both, f), F.when(both, r)
    joined = rows.join(thresholds, [DATE, product])
    high, low = f > F.col("upper"), f < F.col("lower")
    norm = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return joined.groupBy(DATE, product).agg(
        F.avg(F.when(high, r)).alias("upper_bp"), F.count(F.when(high & r.isNotNull(), 1)).alias("upper_n"), F.avg(F.when(low, r)).alias("lower_bp"), F.count(F.when(low & r.isNotNull(), 1)).alias("lower_n"),
        F.when(norm > 0, F.greatest(F.least(F.sum(x * y) / norm, F.lit(1.0)), F.lit(-1.0))).alias("cosine"),
    )


def holding_report(rows: DataFrame, factor: str, label: str, thresholds: DataFrame, product: str = "product", order: str = "trade_time") -> DataFrame:
    """By date and product: the return in basis points of holding with the last threshold passed, positions taken and minutes held.

    A signal of a bar acts from the next open to the one after, which is the
    bar's `label`; between thresholds the position stays; the day's last two
    bars take none. A missing label while a position is held makes the day's
    return missing.
    """
    day = Window.partitionBy(DATE, product).orderBy(order)
    joined = rows.join(thresholds, [DATE, product]).withColumn("_left", F.row_number().over(Window.partitionBy(DATE, product).orderBy(F.col(order).desc()))).filter("_left > 2")
    f, r = finite(F.col(factor)), finite(F.col(label))
    says = F.when(f > F.col("upper"), F.lit(1.0)).when(f < F.col("lower"), F.lit(-1.0))
    placed = joined.withColumn("_says", says).withColumn("_held", F.coalesce(F.last("_says", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    placed = placed.withColumn("_before", F.coalesce(F.lag("_held").over(day), F.lit(0.0)))
    held = F.col("_held") != 0
    whole = (F.count(f) > 0) & (F.count(r) > 0) & (F.count(F.when(held & r.isNull(), 1)) == 0)
    return placed.groupBy(DATE, product).agg(
        F.when(whole, F.sum(F.when(held, F.col("_held") * r).otherwise(F.lit(0.0)))).alias("holding_bp"), F.count(F.when(F.col("_held") != F.col("_before"), 1)).alias("positions"), F.count(F.when(held, 1)).alias("minutes"),
    )
