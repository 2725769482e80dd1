"""Point-in-time chains over statements: what each instrument had disclosed by a date.

Nothing is compared pair by pair with the dates that are asked. What is visible
changes only where something is disclosed, so a snapshot is made for each
disclosure of an instrument, from the versions of its last `quarters` periods,
and dates take the last snapshot before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.calendar import to_day

from .joins import asof_join


def _quarter_number(period: Column) -> Column:
    return F.year(to_day(period)) * 4 + F.quarter(to_day(period))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def visible_snapshots(statements: DataFrame, key: str, period: str, disclosed: str, kind: str, preference: Sequence, update: str, value: str, quarters: int = 20) -> DataFrame:
    """(key, disclosed, held): at each disclosure, the periods visible by then as an array of (q, value), latest first.

    Of a period's versions the first kind in `preference` counts, then the
    latest disclosure, then the greatest update flag, then the greatest value. Versions of a null
    value count as visible.
    """
    order = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    known = statements.withColumn("_order", order).filter((F.col("_order") > 0) & F.col(disclosed).isNotNull())
    known = known.select(F.col(key).alias("_k"), _quarter_number(F.col(period)).alias("q"), F.col(disclosed).alias("_d"), "_order", F.col(update).alias("_u"), F.col(value).cast("double").alias("value"))
    events = known.select(F.col("_k").alias("_key"), F.col("_d").alias("_at")).distinct()
    now = F.year(to_day(F.col("_at"))) * 4 + F.quarter(to_day(F.col("_at")))
    seen = events.join(known, (F.col("_key") == F.col("_k")) & (F.col("_d") <= F.col("_at")) & (F.col("q") > now - quarters))
    best = seen.groupBy("_key", "_at", "q").agg(F.max_by(F.struct("value"), F.struct(-F.col("_order"), F.col("_d"), F.col("_u"), F.col("value"))).alias("best"))
    held = F.sort_array(F.collect_list(F.struct("q", F.col("best.value").alias("value"))), asc=False)
    return best.groupBy("_key", "_at").agg(held.alias("held")).select(F.col("_key").alias(key), F.col("_at").alias(disclosed), "held")


def _run(held: Column, anchor: Column, n: int, step: int) -> Column:
    """The values of `n` periods `step` quarters apart that end at the anchor; null unless all are there."""
    found = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.filter(held, lambda h: h["q"] == anchor["q"] - i * step), F.lit(1))["value"])
    return F.when(F.forall(found, lambda v: v.isNotNull()), found)


def _first_run(held: Column, anchors: Column, n: int, step: int) -> Column:
    """The run of the latest anchor that has one."""
    return F.try_element_at(F.filter(F.transform(anchors, lambda a: _run(held, a, n, step)), lambda r: r.isNotNull()), F.lit(1))


def chain(held: Column, years: int = 3) -> dict[str, Column]:
    """From a snapshot's array: the latest visible quarter and year, trailing four quarters, the latest annual value and `years` of them.

    Four quarters and years in a row need all their values; where the latest
    anchor lacks one, the next older anchor is tried.
    """
    annual = F.filter(held, lambda h: h["q"] % 4 == 0)
    yearly = F.reverse(_first_run(held, annual, years, 4))
    return {
        "latest_quarter": F.try_element_at(held, F.lit(1))["q"], "latest_year": (F.try_element_at(annual, F.lit(1))["q"] / 4 - 1).cast("int"), "ttm": _total(_first_run(held, held, 4, 1)),
        "annual": F.try_element_at(annual, F.lit(1))["value"], "annual_sum": _total(yearly), "annual_first": F.try_element_at(yearly, F.lit(1)),
    }


def financial_chain(asked: DataFrame, statements: DataFrame, key: str, date: str, period: str, disclosed: str, kind: str, preference: Sequence, update: str, value: str, quarters: int = 20, years: int = 3) -> DataFrame:
    """``chain`` of the last disclosure up to each (key, date)."""
    snapshots = visible_snapshots(statements, key, period, disclosed, kind, preference, update, value, quarters)
    columns = chain(F.col("held"), years)
    made = snapshots.select(key, disclosed, *[c.alias(n) for n, c in columns.items()])
    return asof_join(asked, made, [key], date, disclosed, list(columns))


def dividend_sums(asked: DataFrame, dividends: DataFrame, key: str, date: str, announced: str, ex: str, fiscal_end: str, cash: str, months: int = 12) -> DataFrame:
    """Adds `ltm`, the cash of the last `months` whose ex-date and announcement have passed, and `last_year`, that of the fiscal year before the date's.

    A payment counts from the later of both dates until it is `months` old, so
    it is added once and taken away once, and dates take the running sum.
    """
    begins = F.greatest(F.col(announced), F.col(ex))
    paid = dividends.filter(F.col(announced).isNotNull() & F.col(ex).isNotNull() & F.col(cash).isNotNull())
    day = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    ends = day(F.date_add(F.add_months(to_day(F.col(ex)), months), 1))
    changes = paid.select(F.col(key).alias("_k"), F.explode(F.array(F.struct(begins.alias("at"), F.col(cash).alias("by")), F.struct(F.greatest(ends, begins).alias("at"), (-F.col(cash)).alias("by")))).alias("c")).select("_k", "c.at", "c.by")
    steps = changes.groupBy("_k", "at").agg(F.sum("by").alias("by"))
    running = steps.select(F.col("_k").alias(key), "at", F.sum("by").over(Window.partitionBy("_k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("ltm"))
    out = asof_join(asked, running, [key], date, "at", ["ltm"]).withColumn("ltm", F.coalesce("ltm", F.lit(0.0)))
    yearly = paid.filter(F.col(fiscal_end).isNotNull()).groupBy(F.col(key).alias("_k"), F.floor(F.col(fiscal_end) / 10000).alias("_y"), begins.alias("_b")).agg(F.sum(cash).alias("_c"))
    upto = yearly.select(F.col("_k").alias(key), F.col("_y").alias("_year"), "_b", F.sum("_c").over(Window.partitionBy("_k", "_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("last_year"))
    asked_year = out.withColumn("_year", F.floor(F.col(date) / 10000) - 1)
    return asof_join(asked_year, upto, [key, "_year"], date, "_b", ["last_year"]).withColumn("last_year", F.coalesce("last_year", F.lit(0.0))).drop("_year")
