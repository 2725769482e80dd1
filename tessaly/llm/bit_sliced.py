"""Exact top-k search by a bit-sliced index.

Vectors are quantised to integers and dealt to blocks by a hash of their id. A
block keeps, for each attribute, one bitmap over its rows per binary digit of
the attribute less the block's least value. A query's score is a sum of slices:
each binary digit of a coefficient adds the attribute's slices, shifted, and a
negative coefficient adds the complement's, so all terms are positive and the
sum differs from the score by a constant. Full adders over whole bitmaps take
three slices of one weight to one of the same and one of double weight until
each weight has one. The k best rows are then found from the most significant
slice downward: rows that are surely in, and rows still equal to the boundary.
Rows that remain equal after the last slice tie exactly, and the smaller id wins.

Every row is indexed and every score is exact. Vectors move once, to their
block; chunks of queries move to every block and stream past its index, which is
built once and is all that a task holds besides a chunk. A block returns at most
k rows a query, from which the k best are kept. A block holds more rows as the
table grows, up to `most_rows`, so that queries are copied seldom.

Defined results: vectors that are null, or hold null or components that aren't
finite once quantised, take no part, nor do rows whose id is null; missing components of
shorter vectors count as 0; rows that repeat an id are candidates each, save for
the queries of that id; components of any finite size are exact integers, and a
score beyond 64 bits ranks by its true value and shows as the nearest long; with
fewer candidates than k all are returned; other columns play no part; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTUM = 256
_FRACTIONS, _LARGEST = float(1 << 53), 1.7976931348623157e308


def quantised(vector: Column, quantum: int = QUANTUM) -> Column:
    """floor(quantum * x) of each component, as doubles, which hold these integers exactly; null for vectors that take no part."""
    finite = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST / quantum))
    # what floor() gives would have to fit a long; larger doubles are integers already
    whole = F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x) < _FRACTIONS / quantum, F.floor(F.when(F.abs(x) < _FRACTIONS / quantum, x * quantum)).cast("double")).otherwise(x * quantum))
    return F.when(vector.isNotNull() & finite, whole)


class Block:
    """The index of some rows: ids in ascending order, and bit slices by attribute."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], integers(values[order])
        self.n = n = len(ids)
        self.words = (n + 63) // 64
        self.low = values.min(0)
        above = values - self.low
        top = int(above.max()) if above.size else 0
        self.digits = max(1, top.bit_length())
        # slices[attribute, digit] is a bitmap over rows
        self.slices = np.zeros((values.shape[1], self.digits, self.words), np.uint64)
        held = np.zeros(self.words * 64, np.uint8)
        for j in range(values.shape[1]):
            for digit in range(self.digits):
                held[:n] = above[:, j] >> digit & 1
                self.slices[j, digit] = np.packbits(held, bitorder="little").view(np.uint64)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The score of each row as bit slices, least significant first, and what to add to it."""
        query = integers(query)
        full = (1 << self.digits) - 1
        # a negative coefficient c gives c * x = |c| * (full - x) - |c| * full
        shift = sum(a * b for a, b in zip(query.tolist(), self.low.tolist(), strict=True)) - full * -sum(a for a in query.tolist() if a < 0)
        size = np.abs(query)
        weights: dict[int, list[np.ndarray]] = {}
        for digit in range(int(size.max()).bit_length() if size.size else 0):
            held = np.flatnonzero((size >> digit & 1).astype(bool))
            if len(held):
                part = self.slices[held]
                part = part ^ np.where(query[held] < 0, ~np.uint64(0), np.uint64(0))[:, None, None]
                for k in range(self.digits):
                    weights.setdefault(digit + k, []).append(part[:, k])
        out, weight, carried = [], 0, None
        while weights or carried is not None:
            rows = weights.pop(weight, [])
            if carried is not None:
                rows.append(carried)
            carried = None
            carries = []
            have = np.concatenate(rows) if rows else np.zeros((0, self.words), np.uint64)
            while len(have) > 2:
                third = len(have) // 3
                a, b, c = have[:third], have[third : 2 * third], have[2 * third : 3 * third]
                either = a ^ b
                carries.append((a & b) | (either & c))
                have = np.concatenate([either ^ c, have[3 * third :]])
            if len(have) == 2:
                carries.append((have[:1] & have[1:]))
                have = have[:1] ^ have[1:]
            out.append(have[0] if len(have) else np.zeros(self.words, np.uint64))
            if carries:
                carried = np.concatenate(carries)
            weight += 1
            if not weights and carried is None:
                break
        return out, shift

    def top(self, query: np.ndarray, k: int, own_id: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k best rows whose id isn't `own_id`; ties to smaller ids."""
        sums, shift = self.sums(query)
        equal, sure = self.valid.copy(), np.zeros(self.words, np.uint64)
        if own_id is not None:
            for row in range(*np.searchsorted(self.ids, [own_id, own_id + 1])):
                equal[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        for part in reversed(sums):
            with_bit = equal & part
            found = sure | with_bit
            n = int(np.bitwise_count(found).sum())
            if n > k:
                equal = with_bit
            else:
                sure, equal = found, equal & ~part
                if n == k:
                    equal = np.zeros_like(equal)
                    break
        rows = [*self._rows(sure)]
        rows += self._rows(equal)[: k - len(rows)].tolist()
        at = np.array(rows, np.int64)
        scores = [shift] * len(at)
        for weight, part in enumerate(sums):
            for i, bit in enumerate((part[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).tolist()):
                scores[i] += bit << weight
        return [*zip(self.ids[at].tolist(), scores, strict=True)]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: of 64 bits where all are far from that bound, else Python's."""
    if values.dtype == object or np.issubdtype(values.dtype, np.integer):
        return values
    if not values.size or float(np.abs(values).max()) < 2.0**61:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def _matrices(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By row, a list of vectors: all components, and where each vector ends."""
    inner = column.flatten()
    values, ends, first = inner.flatten().to_numpy(zero_copy_only=False), inner.offsets.to_numpy(), column.offsets.to_numpy()
    ends = ends - (ends[0] if len(ends) else 0)
    first = first - (first[0] if len(first) else 0)
    return [(values[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _dense(parts: list[tuple[np.ndarray, np.ndarray]], width: int | None = None) -> np.ndarray:
    """A matrix of vectors; shorter ones end in zeros, what is beyond `width` is left out."""
    sizes = np.concatenate([np.diff(ends) for _, ends in parts]) if parts else np.zeros(0, np.int64)
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0)
    width = int(sizes.max(initial=0)) if width is None else width
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    held = place < width
    out[row[held], place[held]] = values[held]
    return out


def _searched(batches, k: int):
    """Streams rows in order of block, its vectors before its queries: the k best of the block for each query."""
    least, most = -(1 << 63), (1 << 63) - 1
    last, built, ids, parts, width = None, None, [], [], 0
    for batch in batches:
        blocks, asks, own = batch.column("block").to_pylist(), batch.column("asks").to_pylist(), batch.column("ids").to_pylist()
        found = []
        for block, asking, names, held in zip(blocks, asks, own, _matrices(batch.column("vectors")), strict=True):
            if block != last:
                last, built, ids, parts = block, None, [], []
            if not asking:
                ids += names
                parts.append(held)
                continue
            if not parts:
                continue
            if built is None:
                values = _dense(parts)
                built, width = Block(np.array(ids, np.int64), values), values.shape[1]
            for name, query in zip(names, _dense([held], width), strict=True):
                found += [(name, i, str(s), max(least, min(most, s))) for i, s in built.top(query, k, name)]
        if found:
            columns = [*zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([_sortable(int(x)) for x in columns[2]], pa.string()), pa.array(columns[3], pa.int64())], ["query_id", "vec_id", "exact", "score"])


def _sortable(score: int) -> str | None:
    """A text that orders scores beyond 64 bits; null for all others."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return None
    digits = str(abs(score))
    size = len(digits)
    if score < 0:  # larger sizes come first
        size, digits = 9999 - size, digits.translate(str.maketrans("0123456789", "9876543210"))
    return f"{size:04d}{digits}"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None, chunk_rows: int = 128, least_rows: int = 4_096, most_rows: int = 131_072) -> DataFrame:
    """The k candidates of highest integer inner product of each query row: query_id, rank, vec_id, score.

    `is_query` marks query rows by id_col. `block_rows` and `chunk_rows` are how
    many rows a block and how many queries a chunk hold on average; without
    `block_rows`, four blocks a core, of `least_rows` to `most_rows` rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    n, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    block_rows = block_rows or min(most_rows, max(least_rows, n // (4 * vectors.sparkSession.sparkContext.defaultParallelism)))
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-asking // chunk_rows))
    dealt = F.xxhash64("vec_id", "v")
    candidates = rows.select(F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.array("vec_id").alias("ids"), F.array("v").alias("vectors"))
    queries = rows.filter("asks").groupBy(F.pmod(dealt, F.lit(chunks)).alias("chunk")).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vectors"))
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "ids", "vectors")
    streams = candidates.union(sent).repartition(min(blocks, 20_000), "block").sortWithinPartitions("block", "asks")
    best = streams.mapInArrow(lambda batches: _searched(batches, k), "query_id long, vec_id long, exact string, score long")
    # scores beyond 64 bits all show as the same long, and their texts order them
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact").desc_nulls_last(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""
