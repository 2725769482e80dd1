"""Derived tables: first rows, best rows, main contracts with hysteresis, liquidity, peers, decayed events."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; an aggregate, so rows combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_by(rows: DataFrame, keys: Sequence[str], value: str, k: int, tie: str) -> DataFrame:
    """The `k` rows of greatest value by key, with their place from 1; Spark limits each task's rows by key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    return rows.filter(F.col(value).isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def main_contract(rows: DataFrame, product: str, date: str, maturity: str, interest: str) -> DataFrame:
    """The main contract by product and date.

    The first date takes the contract of most open interest, ties to the
    earlier. Later, only a contract of later maturity may take over: one whose
    interest is above the main one's by a tenth or more or, on a date without
    the main one, the largest. Where there is none and the main contract is
    missing, the date has no row. Each date depends on the one before, so a
    product is folded in order, over its dates.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, main = [], None
        for day, part in pdf.sort_values([date, maturity]).groupby(date, sort=True):
            held = dict(zip(part[maturity], part[interest], strict=True))
            now = held.get(main)
            open_ = {m: v for m, v in held.items() if main is None or (m > main and (now is None or (v > now and v * 10 >= now * 11)))}
            if open_:
                main = max(open_, key=lambda m: (open_[m], -m))
            if main in held:
                out.append((pdf[product].iloc[0], day, main, held[main]))
        return pd.DataFrame(out, columns=[product, date, "main", "main_interest"])

    return rows.groupBy(product).applyInPandas(fold, f"{product} {kinds[product]}, {date} {kinds[date]}, main {kinds[maturity]}, main_interest double")


def liquid(panel: DataFrame, volume: str, sessions: int, least: float, code: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Adds `liquid`: all of the previous `sessions` dates have a volume, and their mean is at least `least`."""
    before = Window.partitionBy(code).orderBy(date).rowsBetween(-sessions, -1)
    return panel.withColumn("liquid", F.coalesce((F.count(volume).over(before) == sessions) & (F.avg(volume).over(before) >= least), F.lit(False)))


def strongest_peers(memberships: DataFrame, k: int, block: int = 500) -> DataFrame:
    """From (member, on): the `k` members that share most with each, with the number shared; ties to the smaller member.

    The members of one `on` meet block by block, so a large one is spread over
    pairs of blocks; pairs are counted in each task before they move.
    """
    once = memberships.distinct()
    blocks = once.groupBy("on").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n")).select(F.col("on").alias("_on"), "n")
    placed = once.join(blocks, F.col("on") == F.col("_on")).drop("_on").withColumn("own", F.pmod(F.xxhash64("member"), "n"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    left = placed.select("on", "member", F.col("own").alias("a"), others.alias("b"))
    right = placed.select("on", F.col("member").alias("peer"), F.col("own").alias("b"), others.alias("a"))
    shared = left.join(right, ["on", "a", "b"]).filter("member <> peer").groupBy("member", "peer").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("member").orderBy(F.col("shared").desc(), "peer")
    return shared.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def decayed_events(events: DataFrame, dates: DataFrame, code: str, day: str, kind: str, at: str, half_life: int, window: int) -> DataFrame:
    """By instrument, date and kind: the sum of 2 ** (-age / half_life) of the events of the last `window` days.

    An event meets only the dates of the months that its window reaches, by an
    equality on the month.
    """
    months = window // 28 + 2
    reach = events.select(code, day, kind, F.explode(F.transform(F.sequence(F.lit(0), F.lit(months)), lambda i: F.trunc(F.add_months(F.trunc(F.col(day), "month"), i), "month"))).alias("_month"))
    asked = dates.select(F.col(at), F.trunc(at, "month").alias("_month"))
    age = F.date_diff(F.col(at), F.col(day))
    near = reach.join(asked, "_month").filter((age >= 0) & (age <= window))
    return near.groupBy(code, at, kind).agg(F.sum(F.pow(F.lit(2.0), -age / half_life)).alias("strength"))


def rolling_pool(sessions: DataFrame, product: str, date: str, volume: str, length: int, least: float) -> DataFrame:
    """The products in the pool by date: the `length` sessions before it all have a volume, and their mean is at least `least`."""
    return liquid(sessions, volume, length, least, code=product, date=date).filter("liquid").select(date, product)


def snapshot_members(disclosures: DataFrame, dates: DataFrame, owner: str, available: str, members: str, date: str = "trade_date") -> DataFrame:
    """(date, owner, member): for each date the members of the owner's latest disclosure that was available by then; an empty one ends them."""
    from .joins import asof_join

    asked = disclosures.select(owner).distinct().crossJoin(F.broadcast(dates.select(date).distinct()))  # owners by a calendar
    latest = disclosures.groupBy(owner, available).agg(F.array_distinct(F.flatten(F.collect_list(members))).alias("_members"))
    return asof_join(asked, latest, [owner], date, available, ["_members"]).select(date, owner, F.explode("_members").alias("member"))


def consensus(reports: DataFrame, dates: DataFrame, code: str, org: str, year: str, day: str, value: str, windows: Sequence[int], least: int, date: str = "day") -> DataFrame:
    """Mean forecast by instrument, fiscal year and date, of each institution's latest report in the shortest window that has `least` of them.

    `strict` is the mean where the first window suffices, `wide` that of the
    first window that does, `used` its length, `institutions` their number. A
    report meets the dates of the months that the longest window reaches, by an
    equality on the month.
    """
    months = windows[-1] // 28 + 2
    reach = reports.select(code, org, year, F.col(day).alias("_r"), value, F.explode(F.transform(F.sequence(F.lit(0), F.lit(months)), lambda i: F.trunc(F.add_months(F.trunc(F.col(day), "month"), i), "month"))).alias("_month"))
    asked = dates.select(F.col(date).alias("_at"), F.trunc(date, "month").alias("_month")).distinct()
    age = F.date_diff(F.col("_at"), F.col("_r"))
    near = reach.join(asked, "_month").filter((age >= 0) & (age < windows[-1])).withColumn("_age", age)
    latest = near.groupBy(code, year, "_at", org).agg(F.min("_age").alias("_age"), F.max_by(value, F.struct(-F.col("_age"), F.col(value))).alias("_v"))
    aggregates = []
    for w in windows:
        inside = F.when(F.col("_age") < w, F.col("_v"))
        aggregates += [F.count(inside).alias(f"_n{w}"), F.avg(inside).alias(f"_m{w}")]
    found = latest.groupBy(code, year, "_at").agg(*aggregates)
    first = lambda f: F.coalesce(*[F.when(F.col(f"_n{w}") >= least, f(w)) for w in windows])
    return found.select(
        code, year, F.col("_at").alias(date), F.when(F.col(f"_n{windows[0]}") >= least, F.col(f"_m{windows[0]}")).alias("strict"),
        first(lambda w: F.col(f"_m{w}")).alias("wide"), first(lambda w: F.lit(w)).alias("used"), first(lambda w: F.col(f"_n{w}")).alias("institutions"),
    )


def rolling_year(annual: DataFrame, code: str, year: str, date: str, value: str) -> DataFrame:
    """The forecast for the next twelve months: this fiscal year's weighed by the part of the year that is left, next year's by the rest."""
    left = F.date_diff(F.make_date(F.year(date), F.lit(12), F.lit(31)), F.col(date)) / 365.0
    this = F.max(F.when(F.col(year) == F.year(date), F.col(value)))
    following = F.max(F.when(F.col(year) == F.year(date) + 1, F.col(value)))
    return annual.groupBy(code, date).agg(this.alias("_a"), following.alias("_b")).select(code, date, (F.col("_a") * left + F.col("_b") * (1 - left)).alias("rolling"))
