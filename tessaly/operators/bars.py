"""Bars from finer rows: first, highest, lowest, last, sums and volume-weighted price by key and bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_minute(time: Column) -> Column:
    """The place of a minute in the trading day, 0 to 239; null outside 09:31-11:30 and 13:01-15:00."""
    clock = F.regexp_extract(time, r"(\d{2}):(\d{2})(:\d{2})?$", 1).try_cast("int") * 60 + F.regexp_extract(time, r"(\d{2}):(\d{2})(:\d{2})?$", 2).try_cast("int")
    return F.when(clock.between(571, 690), clock - 571).when(clock.between(781, 900), clock - 781 + 120).cast("int")


def bars(rows: DataFrame, keys: Sequence[str], bucket: Column, order: str, price: dict[str, str], volume: str, amount: str) -> DataFrame:
    """One row by key and bucket; rows with a null or non-finite input are left out, and buckets that are null.

    `price` names the columns of open, high, low and close. The volume-weighted
    price is 0 without volume and null below 0. All aggregates combine before
    the shuffle.
    """
    used = [*dict.fromkeys([*price.values(), volume, amount])]
    finite = F.lit(True)
    for c in used:
        d = F.col(c).cast("double")
        finite = finite & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    grouped = rows.withColumn("bar_index", bucket).filter(finite & F.col("bar_index").isNotNull()).groupBy(*keys, "bar_index")
    out = grouped.agg(
        F.min_by(price["open"], order).alias("open"), F.max(price["high"]).alias("high"), F.min(price["low"]).alias("low"), F.max_by(price["close"], order).alias("close"),
        F.sum(volume).alias("vol"), F.sum(amount).alias("amount"), F.count(F.lit(1)).cast("int").alias("minute_count"),
    )
    return out.withColumn("vwap", F.when(F.col("vol") > 0, F.col("amount") / F.col("vol")).when(F.col("vol") == 0, F.lit(0.0)))


def minute_bars(rows: DataFrame, n: int) -> DataFrame:
    """N-minute bars of trading minutes; `n` divides 240 and lies in 2..120."""
    if not 1 < n <= 120 or 240 % n:
        raise ValueError("bars need a length from 2 to 120 that divides 240")
    placed = rows.withColumn("minute", session_minute(F.col("trade_time")))
    return bars(placed, ["trade_date", "ts_code"], F.floor(F.col("minute") / n).cast("int"), "minute", {c: c for c in ("open", "high", "low", "close")}, "vol", "amount")
