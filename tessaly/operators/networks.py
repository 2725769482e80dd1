"""Networks of shared coverage, peers by similarity, path signatures, event strengths, holding ages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.functions.timeseries import EPS


class _Block(NamedTuple):
    """Members in order, their values and what they hold: member `row_at[k]` holds `ons[on_at[k]]`. leads: those marked."""

    members: pa.Array
    value: np.ndarray
    has: np.ndarray
    ons: pa.Array
    on_at: np.ndarray
    row_at: np.ndarray
    leads: np.ndarray


def _read(held: pa.StructScalar) -> _Block:
    members, value = held["members"].values, held["value"].values
    places = np.cumsum(np.frombuffer(zlib.decompress(held["places"].as_py()), "<i8"))
    marked = held["leads"].values if "leads" in held else None
    leads = np.zeros(len(members), bool) if marked is None else pc.is_in(members, value_set=marked).to_numpy(zero_copy_only=False)
    on_at, row_at = np.divmod(places, len(members))
    return _Block(members, value.to_numpy(zero_copy_only=False).astype(np.float64), value.is_valid().to_numpy(zero_copy_only=False), held["ons"].values, on_at, row_at, leads)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's lists as one compressed list of steps between places of a matrix, a few bits for each that is held."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    for batch in batches:
        for i in range(batch.num_rows):
            members, value, lists = batch.column("rows")[i].values.flatten()
            order = pc.array_sort_indices(members)
            members, value, lists = members.take(order), value.take(order), lists.take(order)
            coded = lists.flatten().dictionary_encode()
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            places = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lists) + rows)
            steps = zlib.compress(np.diff(places, prepend=0).astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([batch.column("own").slice(i, 1), one(members), one(value), one(coded.dictionary), pa.array([steps], pa.binary())], ["own", "members", "value", "ons", "places"])


def _own(n: int) -> Column:
    return F.pmod(F.xxhash64("member"), F.lit(n))


def _size(memberships: DataFrame, block: int, most: int = 4_000_000) -> tuple[int, int]:
    """The number of members, and of blocks of about `block` members and at most about `most` memberships."""
    members, rows = memberships.select("member", "on").dropna().agg(F.count_distinct("member"), F.count(F.lit(1))).first()
    return members, min(members, max(-(-members // block), -(-rows // most))) or 1


def _blocks(memberships: DataFrame, n: int, values: DataFrame | None = None) -> DataFrame:
    """(own, held) of `n` blocks; without `values`, members have none."""
    member, on = (memberships.schema[c].dataType.simpleString() for c in ("member", "on"))
    one_zero = F.col("on") + F.lit(0).cast(on) if on in ("float", "double") else F.col("on")
    lists = memberships.select("member", one_zero.alias("on")).dropna().groupBy("member").agg(F.collect_set("on").alias("ons"))
    none = F.lit(None).cast("double").alias("value")
    lists = lists.select("member", none, "ons") if values is None else lists.join(values.select("member", F.col("value").cast("double").alias("value")), "member", "left").select("member", "value", "ons")
    grouped = lists.groupBy(_own(n).alias("own")).agg(F.collect_list(F.struct("member", "value", "ons")).alias("rows"))
    packed = grouped.mapInArrow(_pack, f"own long, members array<{member}>, value array<double>, ons array<{on}>, places binary")
    return packed.select("own", F.struct("members", "value", "ons", "places").alias("held"))


def _met(blocks: DataFrame, n: int, panels: DataFrame | None = None, m: int = 1) -> DataFrame:
    """(a, b, left, right) of each two blocks, a <= b; with `m` panels, of each panel too: (p, panel)."""
    keys, last = ["a", "b"], F.lit(n - 1).cast("long")
    left = blocks.select(F.col("own").alias("a"), F.explode(F.sequence("own", last)).alias("b"), F.col("held").alias("left"))
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("a"), F.col("own").alias("b"), F.col("held").alias("right"))
    sides = [left, right]
    if panels is not None:
        keys, every = ["p", "a", "b"], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("p")
        whole = panels.select(F.col("own").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("a"), F.col("held").alias("panel"))
        sides = [left.select(every, "*"), right.select(every, "*"), whole.select("p", "a", F.explode(F.sequence("a", last)).alias("b"), "panel")]
    first, *rest = (x.repartition(m * n * (n + 1) // 8 + 1, *keys) for x in sides)
    for x in rest:
        first = first.join(x, keys)
    return first


def _shared(left: _Block, right: _Block, width: int = 4096) -> np.ndarray:
    """How many values each member of `left` shares with each of `right`: products of 0/1 matrices, some columns at a time."""
    codes = pa.concat_arrays([left.ons, right.ons]).dictionary_encode().indices.to_numpy()
    code_a, code_b = codes[: len(left.ons)], codes[len(left.ons) :]
    both = np.intersect1d(code_a, code_b)
    found = np.zeros((len(left.members), len(right.members)))
    for at in range(0, len(both), width):
        part, sides = both[at : at + width], []
        for x, codes in ((left, code_a), (right, code_b)):
            place = np.minimum(np.searchsorted(part, codes), len(part) - 1)
            held = (part[place] == codes)[x.on_at]
            matrix = np.zeros((len(x.members), len(part)), np.float32)
            matrix[x.row_at[held], place[x.on_at[held]]] = 1
            sides.append(matrix)
        found += sides[0] @ sides[1].T
    return found


def _linked(left: _Block, right: _Block, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values linked members share, else 0; and which are apart: two members that aren't linked."""
    w = _shared(left, right)
    apart = w < max(least, 1)
    own = pc.index_in(left.members, value_set=right.members)
    r = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
    c = own.drop_null().to_numpy()
    w[apart], w[r, c], apart[r, c] = 0, 0, False
    return w, apart


def shared_links(memberships: DataFrame, least: int, block: int = 500) -> DataFrame:
    """(member, peer, w) of members that share `least` or more, w their number; both directions.

    Members are packed into blocks of about `block`, and each two blocks meet
    once, as a matrix product, so no pair is moved for each thing that it shares.
    """
    n = _size(memberships, block)[1]
    return _links(_met(_blocks(memberships, n), n), least, memberships.schema["member"].dataType.simpleString())


def _links(met: DataFrame, least: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = _read(batch.column("left")[i]), _read(batch.column("right")[i])
                w, _ = _linked(a, b, least)
                r, c = np.nonzero(w)
                x, y, w = a.members.take(pa.array(r)), b.members.take(pa.array(c)), pa.array(w[r, c].astype(np.int64))
                yield pa.RecordBatch.from_arrays([x, y, w], ["member", "peer", "w"])
                if batch.column("a")[i] != batch.column("b")[i]:
                    yield pa.RecordBatch.from_arrays([y, x, w], ["member", "peer", "w"])

    return met.mapInArrow(run, f"member {kind}, peer {kind}, w long")


def _sums(w: np.ndarray, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """By row, the sum of weights and of weights times values, over those of the block's members that have a value."""
    fine = block.has & np.isfinite(block.value)
    total = w @ np.where(fine, block.value, 0.0)
    for k in np.flatnonzero(block.has & ~fine):
        total += np.where(w[:, k] > 0, block.value[k], 0.0)
    return w @ block.has.astype(np.float64), total


def _direct(met: DataFrame, least: int, kind: str) -> DataFrame:
    """By member: links, pairs apart in which it is the one that holds less, neighbours with a value, and the sums of their weights and values."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = _read(batch.column("left")[i]), _read(batch.column("right")[i])
                same = batch.column("a")[i] == batch.column("b")[i]
                w, apart = _linked(a, b, least)
                first = np.zeros_like(apart)
                if apart.any():
                    held_a, held_b = (np.bincount(x.row_at, minlength=len(x.members)) for x in (a, b))
                    tie = np.arange(len(held_a))[:, None] < np.arange(len(held_b)) if same else True
                    first = (held_a[:, None] < held_b) | (held_a[:, None] == held_b) & tie
                for x, y, w, lead in ((a, b, w, apart & first), (b, a, w.T, (apart & ~first).T))[: 1 if same else 2]:
                    linked = w > 0
                    yield pa.RecordBatch.from_arrays([x.members, *map(pa.array, (linked.sum(1), lead.sum(1), (linked & y.has).sum(1), *_sums(w, y)))], ["member", "linked", "leads", "neighbours", "w", "total"])

    rows = met.mapInArrow(run, f"member {kind}, linked long, leads long, neighbours long, w double, total double")
    return rows.groupBy("member").agg(*[F.sum(c).alias(c) for c in ("linked", "leads", "neighbours", "w", "total")])


def _indirect(met: DataFrame, least: int, kind: str) -> DataFrame:
    """(member, indirect) where each pair apart has a member in a panel: ways from a panel to a block by way of another are a product of two matrices."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p, a, b = (_read(batch.column(c)[i]) for c in ("panel", "left", "right"))
                (w_a, apart_a), (w_b, apart_b) = _linked(p, a, least), _linked(p, b, least)
                between = None
                for x, w, apart in ((a, w_b, apart_a), (b, w_a, apart_b))[: 1 if batch.column("a")[i] == batch.column("b")[i] else 2]:
                    if not apart.any():
                        continue
                    between = _linked(a, b, least)[0] if between is None else between
                    ways = np.where(apart, w @ (between.T if x is a else between), 0.0)
                    for y, sums in ((p, _sums(ways, x)), (x, _sums(ways[:, ~x.leads].T, p))):
                        members = y.members if y is p else y.members.filter(pa.array(~y.leads))
                        some = pa.array(sums[0] > 0)
                        yield pa.RecordBatch.from_arrays([members.filter(some), *(pa.array(s).filter(some) for s in sums)], ["member", "w", "total"])

    rows = met.mapInArrow(run, f"member {kind}, w double, total double")
    return rows.groupBy("member").agg((F.sum("total") / F.sum("w")).alias("indirect"))


#: Multiplications of a matrix product that take about as long as a row of a join.
_PRODUCTS = 10_000


def shared_means(memberships: DataFrame, values: DataFrame, least: int, block: int = 2000) -> DataFrame:
    """`neighbour_means` of `shared_links`, without a row for each link.

    Members meet as in `shared_links`, and only each member's sums leave a block.
    Two steps away: of each pair that isn't linked, the member that holds less is
    put into panels, and a panel's ways through each block are matrix products.
    Where links are so few that walking them is less work, they are.
    """
    members, n = _size(memberships, block)
    kind = memberships.schema["member"].dataType.simpleString()
    blocks = _blocks(memberships, n, values).persist(StorageLevel.DISK_ONLY)
    sums = _direct(_met(blocks, n), least, kind).persist(StorageLevel.DISK_ONLY)
    leads, ways = sums.agg(F.count_if(F.col("leads") > 0), F.sum(F.col("linked").cast("double") ** 2)).first()
    direct = sums.filter("neighbours > 0").select("member", "neighbours", (F.col("total") / F.col("w")).alias("direct"))
    if not leads:
        return direct.withColumn("indirect", F.lit(None).cast("double"))
    if leads * members**2 > _PRODUCTS * ways:
        links = _links(_met(blocks, n), least, kind).persist(StorageLevel.DISK_ONLY)
        return direct.join(_mean_of_peers(_two_steps(links), values, "indirect").drop("neighbours"), "member", "left")
    led = sums.filter("leads > 0").select("member")
    marks = led.groupBy(_own(n).alias("own")).agg(F.collect_list("member").alias("leads"))
    marked = blocks.join(marks, "own", "left").select("own", F.struct("held.*", "leads").alias("held"))
    m = -(-leads // block)
    panels = _blocks(memberships.join(led, "member", "left_semi"), m, values)
    return direct.join(_indirect(_met(marked, n, panels, m), least, kind), "member", "left")


def _mean_of_peers(links: DataFrame, values: DataFrame, out: str) -> DataFrame:
    """The weighted mean of peers' values by member; a peer without a value counts for nothing."""
    held = links.join(values.filter("value is not null").withColumnRenamed("member", "peer"), "peer")
    return held.groupBy("member").agg(F.count(F.lit(1)).alias("neighbours"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias(out))


def _two_steps(links: DataFrame) -> DataFrame:
    """(member, peer, w) of members two steps apart that aren't linked, w the sum over ways of the products of weights.

    Where nearly all members are linked, the few pairs that aren't look up their
    ways; else all ways are walked, whichever makes fewer rows.
    """
    degrees = links.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    n, once, twice = degrees.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n").cast("double") ** 2)).first()
    second = links.select(F.col("member").alias("via"), F.col("peer").alias("far"), F.col("w").alias("w2"))
    first = links.select("member", F.col("peer").alias("via"), "w")
    ways = F.sum(F.col("w") * F.col("w2")).alias("w")
    if n and (n * (n - 1) - once) * (once / n) + n * n < twice:
        members = degrees.select("member")
        apart = members.crossJoin(members.withColumnRenamed("member", "far")).filter("member <> far").join(links.select("member", F.col("peer").alias("far")), ["member", "far"], "left_anti")
        walked = apart.join(first, "member").join(second, ["via", "far"]).groupBy("member", "far").agg(ways)
        return walked.withColumnRenamed("far", "peer")
    two = first.join(second, "via").filter("far <> member").groupBy("member", "far").agg(ways).withColumnRenamed("far", "peer")
    return two.join(links.select("member", "peer"), ["member", "peer"], "left_anti")


def neighbour_means(links: DataFrame, values: DataFrame) -> DataFrame:
    """(member, neighbours, direct, indirect): the mean of direct neighbours by weight, and of those two steps away that aren't direct, by products of weights."""
    links = links.persist(StorageLevel.DISK_ONLY)
    indirect = _mean_of_peers(_two_steps(links), values, "indirect").drop("neighbours")
    return _mean_of_peers(links, values, "direct").join(indirect, "member", "left")


def log_signature(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The path's log-signature to level 2 by key: increments s_a, and the signed areas a_a_b between each pair of columns."""
    own = Window.partitionBy(*keys).orderBy(order)
    steps = rows.select(*keys, *[x.alias(n) for c in columns for n, x in ((f"_f_{c}", F.first(c).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), (f"_p_{c}", F.lag(c).over(own)), (f"_n_{c}", F.col(c)))])
    move, at = lambda c: F.col(f"_n_{c}") - F.col(f"_p_{c}"), lambda c: F.col(f"_p_{c}") - F.col(f"_f_{c}")
    sums = [F.coalesce(F.sum(move(c)), F.lit(0.0)).alias(f"s_{c}") for c in columns]
    sums += [F.coalesce(F.sum(at(a) * move(b) - at(b) * move(a)) / 2, F.lit(0.0)).alias(f"a_{a}_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return steps.groupBy(*keys).agg(*sums)


def event_strengths(events: DataFrame, dates: DataFrame, code: str, day: str, kind: str, at: str, kinds: Sequence[str], half_life: int, window: int) -> DataFrame:
    """One column s_kind a kind: the sum of 2 ** (-age / half_life) of its events of the last `window` days; 0 without any."""
    from .derived import decayed_events

    long = decayed_events(events.filter(F.col(kind).isNotNull()), dates, code, day, kind, at, half_life, window)
    cell = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("strength"))), F.lit(0.0)).alias(f"s_{k}")
    return long.groupBy(code, at).agg(*[cell(k) for k in kinds])


def comparable_values(rows: DataFrame, vector: str, value: str, date: str = "trade_date", code: str = "ts_code", least: float = 0.9, top: int = 6) -> DataFrame:
    """A value against that of similar names of the date: cosine above `least` makes a peer, the `top` most similar the near ones.

    Adds med, max and min of the near ones' values, avg and weighted (by
    similarity) of all peers', dst = own - med and prm = own / med - 1. A
    date's vectors are one matrix product, in blocks of rows.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    out = ("med", "max", "min", "avg", "weighted", "dst", "prm")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(code).reset_index(drop=True)
        v = np.array(pdf[vector].tolist(), np.float64)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS)
        x = pdf[value].to_numpy(np.float64)
        found = np.full((len(pdf), len(out)), np.nan)
        for at in range(0, len(pdf), 1024):
            near = v[at : at + 1024] @ v.T
            for i, sims in enumerate(near):
                sims[at + i] = -np.inf
                peers = np.flatnonzero((sims > least) & ~np.isnan(x))
                if not len(peers):
                    continue
                order = peers[np.argsort(-sims[peers], kind="stable")]
                best = x[order[:top]]
                med = float(np.median(best))
                own = x[at + i]
                found[at + i] = (med, best.max(), best.min(), x[peers].mean(), float(sims[peers] @ x[peers] / sims[peers].sum()), own - med, own / med - 1 if abs(med) > EPS else np.nan)
        return pdf.assign(**{n: pd.Series(found[:, k]).astype(object).where(~np.isnan(found[:, k]), None) for k, n in enumerate(out)})

    return rows.groupBy(date).applyInPandas(run, ", ".join(fields) + "".join(f", `{n}` double" for n in out))


def chip_ages(rows: DataFrame, code: str = "ts_code", date: str = "trade_date", days: int = 250, edges: Sequence[int] = (20, 60, 120)) -> DataFrame:
    """Shares of the float by the age of their last trade: what each day traded survives by exp(-turnover) a day, over `days`.

    Columns age_0 to age_n for ages up to each edge and beyond; they add up to 1
    once something has traded.
    """
    kind_code, kind_date = rows.schema[code].dataType.simpleString(), rows.schema[date].dataType.simpleString()
    names = [f"age_{k}" for k in range(len(edges) + 1)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        t = pdf["turnover"].fillna(0.0).clip(lower=0.0).to_numpy(np.float64)
        upto = np.cumsum(t)
        out = np.full((len(t), len(names)), np.nan)
        for i in range(len(t)):
            first = max(0, i + 1 - days)
            mass = (1 - np.exp(-t[first : i + 1])) * np.exp(-(upto[i] - upto[first : i + 1]))
            if mass.sum() > EPS:
                age = np.arange(i - first, -1, -1)
                group = np.searchsorted(np.array(edges), age, side="left")
                out[i] = np.bincount(group, mass, len(names)) / mass.sum()
        frame = {code: pdf[code].to_numpy(), date: pdf[date].to_numpy()}
        return pd.DataFrame(frame | {n: pd.Series(out[:, k]).astype(object).where(~np.isnan(out[:, k]), None) for k, n in enumerate(names)})

    return rows.select(code, date, "turnover").groupBy(code).applyInPandas(run, f"{code} {kind_code}, {date} {kind_date}, " + ", ".join(f"{n} double" for n in names))
