"""The trading calendar: sessions on, before and after dates, by place among all sessions.

A calendar holds some thousand dates, so it is ordered as a whole; rows of any
size meet it by an equality on the date that they ask about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Sessions:
    """Lookups over the distinct dates of `open_dates`; each adds a column to the rows that ask, null where there is no such session."""

    def __init__(self, open_dates: DataFrame, date: str = "trade_date"):
        self.days = open_dates.select(F.col(date).alias("_day")).filter("_day is not null").distinct()
        self.placed = self.days.withColumn("_place", F.row_number().over(Window.orderBy("_day")) - 1)

    def _counted(self, rows: DataFrame, on: str) -> DataFrame:
        """Adds how many sessions lie before (`_before`) and up to (`_upto`) the date."""
        asked = rows.select(F.col(on).alias("_day")).filter("_day is not null").distinct()
        marked = asked.withColumn("_open", F.lit(0)).union(self.days.withColumn("_open", F.lit(1)))
        by_day = marked.groupBy("_day").agg(F.max("_open").alias("_open"))
        upto = by_day.withColumn("_upto", F.sum("_open").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)))
        known = upto.select(F.col("_day").alias("_asked"), (F.col("_upto") - F.col("_open")).alias("_before"), "_upto")
        return rows.join(known, F.col(on) == F.col("_asked"), "left").drop("_asked")

    def _at(self, rows: DataFrame, on: str, out: str, place: Column) -> DataFrame:
        found = self.placed.select(F.col("_day").alias(out), F.col("_place").alias("_found"))
        asked = self._counted(rows, on).withColumn("_wanted", place)
        return asked.join(found, F.col("_wanted") == F.col("_found"), "left").drop("_before", "_upto", "_wanted", "_found")

    def first_on_or_after(self, rows: DataFrame, on: str, out: str) -> DataFrame:
        return self._at(rows, on, out, F.col("_before"))

    def last_on_or_before(self, rows: DataFrame, on: str, out: str) -> DataFrame:
        return self._at(rows, on, out, F.col("_upto") - 1)

    def previous(self, rows: DataFrame, on: str, out: str) -> DataFrame:
        """The last session before the date."""
        return self._at(rows, on, out, F.col("_before") - 1)

    def after(self, rows: DataFrame, on: str, out: str, n: int) -> DataFrame:
        """The n-th session after a date that is one itself."""
        return self._at(rows, on, out, F.when(F.col("_upto") > F.col("_before"), F.col("_before") + n))

    def warmup_start(self, rows: DataFrame, on: str, out: str, n: int) -> DataFrame:
        """The session `n` before the first on or after the date, or the first of all; a date after all counts as the last session."""
        total = self.days.agg(F.count(F.lit(1)).alias("_all"))
        if n == 0:
            return rows.withColumn(out, F.col(on))
        asked = self._counted(rows, on).crossJoin(F.broadcast(total))  # one row
        place = F.greatest(F.least(F.col("_before"), F.col("_all") - 1) - n, F.lit(0))
        found = self.placed.select(F.col("_day").alias("_start"), F.col("_place").alias("_found"))
        out_col = F.coalesce("_start", F.col(on)).alias(out)
        return asked.withColumn("_wanted", place).join(found, F.col("_wanted") == F.col("_found"), "left").select(*rows.columns, out_col)

    def month_end_on_or_before(self, rows: DataFrame, on: str, out: str) -> DataFrame:
        """The last session up to the date that a session of a later month follows."""
        follows = F.lead("_day").over(Window.orderBy("_day"))
        ends = self.days.withColumn("_next", follows).filter(F.floor(F.col("_next") / 100) != F.floor(F.col("_day") / 100)).select("_day")
        return Sessions(ends, "_day").last_on_or_before(rows, on, out)

    def between(self, start: int, end: int) -> DataFrame:
        return self.days.filter(F.col("_day").between(start, end)).select(F.col("_day").alias("trade_date"))


def _to_cents(price: Column) -> Column:
    """A price to two decimals as double arithmetic gives it: whole hundredths of `100 * price`, halves away from zero.

    Spark's own ``round`` goes by the shortest decimal that the double prints
    as, which puts halves of a cent elsewhere.
    """
    hundredths = F.round(price * 100)
    return F.when(F.abs(hundredths) < float("inf"), hundredths / 100).otherwise(price)


def tradeability(prices: DataFrame, limits: DataFrame, flagged: DataFrame, date: str = "trade_date", code: str = "ts_code", close: str = "close") -> DataFrame:
    """Flags of each price row: at its upper limit, at its lower, at either, and whether `flagged` (date, code) names it.

    Prices are compared to two decimals, each rounded as a double; a missing one is at no limit.
    """
    joined = prices.select(date, code, close).join(limits.select(date, code, "up_limit", "down_limit"), [date, code], "left")
    marked = joined.join(flagged.select(date, code).distinct().withColumn("is_st", F.lit(True)), [date, code], "left")
    at, upper, lower = _to_cents(F.col(close)), _to_cents(F.col("up_limit")), _to_cents(F.col("down_limit"))
    up, down = F.coalesce(at >= upper, F.lit(False)), F.coalesce(at <= lower, F.lit(False))
    return marked.select(date, code, up.alias("is_limit_up"), down.alias("is_limit_down"), (up | down).alias("is_limit"), F.coalesce("is_st", F.lit(False)).alias("is_st"))


def _dates_as_of(dates: DataFrame, snapshots: DataFrame, date: str, effective: str) -> DataFrame:
    """(date, last effective date up to it) of each date; both sides are calendars."""
    marked = dates.select(F.col(date).alias("_d"), F.lit(1).alias("_asks")).distinct().union(snapshots.select(F.col(effective).alias("_d"), F.lit(0).alias("_asks")).distinct())
    order = Window.orderBy("_d", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumn("_effective", F.last(F.when(F.col("_asks") == 0, F.col("_d")), ignorenulls=True).over(order))
    return found.filter("_asks = 1").select(F.col("_d").alias(date), "_effective")


def members_as_of(dates: DataFrame, snapshots: DataFrame, date: str = "trade_date", effective: str = "effective_date") -> DataFrame:
    """The whole snapshot in force on each date: the latest replaces the one before it, members that it lacks included."""
    return _dates_as_of(dates, snapshots, date, effective).join(snapshots, F.col("_effective") == F.col(effective)).drop("_effective", effective)


def carried_forward(grid: DataFrame, snapshots: DataFrame, values: list[str], date: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """`values` of each cell of the grid from the last date that has a snapshot; what that snapshot lacks or holds as null is null."""
    there = _dates_as_of(grid, snapshots, date, date)
    held = snapshots.select(F.col(date).alias("_effective"), code, *values)
    return grid.join(there, date, "left").join(held, ["_effective", code], "left").drop("_effective")


def features_with_labels(features: DataFrame, labels: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Features joined to labels of the same keys; an error at run time where a key occurs twice on either side."""

    def once(rows: DataFrame, side: str) -> DataFrame:
        alike = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return rows.withColumn("_n", alike).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} repeat a key")).cast("boolean")).otherwise(F.lit(True))).drop("_n")

    return once(features, "features").join(once(labels, "labels"), keys, how)
