"""Joins by interval, by disclosure and by trading-day offset, without comparing every pair.

Where a lookup wants the last row at or before a date, both sides are unioned and
one ordered window carries the last row forward; where it wants the best of a
few rows of a key, they are joined as one array. So no row is matched twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = 99991231


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, values: Sequence[str], width: int | None = None) -> DataFrame:
    """For each left row, `values` of the last right row of equal keys with right_on <= on; of equal right_on, of the greatest values.

    With a `width`, numbers on the axis are cut into spans so wide, and each
    span of a key is a window of its own that the last row before it enters, so
    a key that holds much of the data is spread over its spans.
    """
    held = F.struct(*[F.col(v) for v in values])
    kind = right.select(held.alias("s")).schema["s"].dataType
    span = F.lit(0) if width is None else F.floor(F.col("_at") / width)
    lefts = left.select("*", F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_row")).withColumn("_span", span)
    rights = right.filter(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), held.alias("_row")).withColumn("_span", span)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_span").orderBy("_at", "_side", "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_row", ignorenulls=True).over(order)).filter("_side = 1")
    if width is None:
        return found.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
    # one row a key and span: its last right row, and what was last before it
    spans = both.groupBy(*keys, "_span").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_row"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    entering = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_span").alias("_s"), F.last("_last", ignorenulls=True).over(before)["_row"].alias("_entering"))
    same = F.col("_span") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = found.join(entering, same, "left").withColumn("_found", F.coalesce("_found", "_entering"))
    return out.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def _first_of(left: DataFrame, right: DataFrame, keys: Sequence[str], entry, order, usable, out) -> DataFrame:
    """Joins each key's right rows as one sorted array, and takes the first that is usable: no row is ever repeated."""
    own = right.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(F.struct(*order, *entry))).alias("_held"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    found = left.join(own, same, "left").withColumn("_first", F.try_element_at(F.filter("_held", usable), F.lit(1)))
    return found.select(*left.columns, *out(F.col("_first")))


def interval_join(left: DataFrame, intervals: DataFrame, on: str, key: str, start: str, end: str, value: str) -> DataFrame:
    """The value of the latest interval by `start` that holds each left row's date; a null end is open, an empty value is no interval.

    Of equal starts the greater end and value come first. Intervals are few a key.
    """
    usable = intervals.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    entry = [F.col(start).alias("_s"), F.coalesce(F.col(end), F.lit(OPEN_END)).alias("_e"), F.col(value).alias("_v")]
    order = [(-F.col(start)).alias("_o1"), (-F.coalesce(F.col(end), F.lit(OPEN_END))).alias("_o2")]
    last_value = Window.partitionBy(key, start, F.coalesce(F.col(end), F.lit(OPEN_END)))
    once = usable.withColumn("_greatest", F.max(value).over(last_value)).filter(F.col(value) == F.col("_greatest")).drop("_greatest").dropDuplicates([key, start, end, value])
    return _first_of(left, once, [key], entry, order, lambda h: (h["_s"] <= F.col(on)) & (F.col(on) <= h["_e"]), lambda f: [f["_v"].alias(value)])


def point_in_time(asked: DataFrame, statements: DataFrame, key: str, period: str, date: str, disclosed: str, kind: str, preference: Sequence, update: str, values: Sequence[str]) -> DataFrame:
    """For each (key, date, period): the version that was known by then.

    The first kind in `preference` with a version disclosed at or before the
    date; of that kind the latest disclosure, then the greatest update flag.
    Versions are few a key and period.
    """
    order = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    known = statements.withColumn("_order", order).filter((F.col("_order") > 0) & F.col(disclosed).isNotNull())
    entry = [F.col(disclosed).alias("_d"), F.struct(*values).alias("_v")]
    return _first_of(asked, known, [key, period], entry, [F.col("_order"), (-F.col(disclosed)).alias("_o1"), (-F.col(update)).alias("_o2")], lambda h: h["_d"] <= F.col(date), lambda f: [f["_v"][v].alias(v) for v in values])


def ordinals(dates: DataFrame, date: str = "trade_date") -> DataFrame:
    """Each distinct date with its place among them, from 0; a calendar is small and ordered as a whole."""
    return dates.select(date).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(date)) - 1)


def shifted(rows: DataFrame, values: Sequence[str], k: int, keys: Sequence[str] = ("ts_code",), date: str = "trade_date") -> DataFrame:
    """`values` of `k` dates later, by a join on the dates' places, so gaps of an instrument count as dates."""
    calendar = ordinals(rows, date)
    placed = rows.join(calendar, date)
    later = placed.select(*keys, (F.col("ordinal") - k).alias("ordinal"), *[F.col(v).alias(f"{v}_{k}") for v in values])
    return placed.join(later, [*keys, "ordinal"], "left").drop("ordinal")


def trailing_quarters(values: DataFrame, key: str, quarter: str, value: str, n: int = 4) -> DataFrame:
    """The sum of `n` quarters in a row, all of them needed; `quarter` counts quarters."""
    frame = Window.partitionBy(key).orderBy(quarter).rangeBetween(1 - n, 0)
    return values.withColumn("ttm", F.when(F.count(value).over(frame) == n, F.sum(value).over(frame)))
