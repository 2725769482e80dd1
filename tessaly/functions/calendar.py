"""Dates as integers YYYYMMDD: arithmetic, periods and rebalance schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = ("daily", "weekly", "biweekly", "monthly", "quarterly", "semiannual", "annual")


def to_day(key: Column) -> Column:
    return F.make_date(F.floor(key / 10000).cast("int"), (F.floor(key / 100) % 100).cast("int"), (key % 100).cast("int"))


def from_day(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def add_days(key: Column, n: int) -> Column:
    return from_day(F.date_add(to_day(key), n))


def add_months(key: Column, n: int) -> Column:
    """Kept within the month that it reaches."""
    return from_day(F.add_months(to_day(key), n))


def previous_quarter_end(key: Column) -> Column:
    return from_day(F.date_sub(F.trunc(to_day(key), "quarter"), 1))


def month_end(key: Column) -> Column:
    return from_day(F.last_day(to_day(key)))


def week_number(key: Column) -> Column:
    """Weeks since the epoch, counted from Saturdays' end as floor((day + 2) / 7)."""
    return F.floor((F.unix_date(to_day(key)) + 2) / 7)


def period_key(key: Column, period: str) -> Column:
    year, month = F.floor(key / 10000), F.floor(key / 100) % 100
    return {
        "daily": key, "weekly": week_number(key), "biweekly": week_number(key), "monthly": F.floor(key / 100),
        "quarterly": year * 10 + F.floor((month - 1) / 3) + 1, "semiannual": year * 10 + F.floor((month - 1) / 6) + 1, "annual": year,
    }[period].cast("long")


def rebalance_dates(dates: DataFrame, rule: str | int, date: str = "trade_date") -> DataFrame:
    """The last date of each period within the dates given (every second of them for two weeks), or each `rule`-th date."""
    whole = Window.orderBy(date)  # a calendar: some thousand rows
    days = dates.select(date).distinct()
    if isinstance(rule, int):
        return days.withColumn("_n", F.row_number().over(whole) - 1).filter(F.col("_n") % rule == 0).select(date)
    own = days.withColumn("_p", period_key(F.col(date), rule))
    ends = own.withColumn("_next", F.lead("_p").over(whole)).filter(F.col("_next").isNull() | (F.col("_next") != F.col("_p"))).select(date)
    if rule == "biweekly":
        ends = ends.withColumn("_n", F.row_number().over(whole) - 1).filter(F.col("_n") % 2 == 0).select(date)
    return ends
