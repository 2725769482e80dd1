"""Near-duplicate classes of texts: BagMinHash signatures, bands, verified multiset overlap.

A text is the multiset of its 5-word shingles; a text of fewer words is one
shingle. Two texts are linked when the weighted Jaccard similarity of their
multisets is 0.8 or more, and a class is a connected component of links.

Signatures. Each shingle owns independent Poisson processes over weight
intervals [0, 1), [1, 2), [2, 4), [4, 8) ...; a point has an arrival time, a
signature slot and, where the shingle's weight ends inside the interval, a
weight, and counts only below the shingle's weight. A slot keeps its earliest
point, so two texts agree in a slot with the chance of their weighted Jaccard
similarity. A process stops once it is later than the latest slot, hence most
shingles of a long text cost one point. Times are integers, so a point is the
same whatever else is computed with it.

Classes. Texts of equal words collapse first. `bands` bands of `rows` slots give
buckets. In a bucket, texts are compared with the smallest id only; links join
texts to components. Buckets that then hold one component are done. All texts of
the others meet in an exact join: of each text the rarest fifth of its shingles
(no pair of 0.8 shares none of these), less the pairs whose places in that order
leave too little to share. So no link between candidates is lost, and a large
group of copies costs a comparison or two each, not all pairs.

Verification compares multisets by 32-bit hashes of (shingle, occurrence); the
expected share of false matches is below one in 2**32 times the text's length.
Where all texts meet in the exact join, elements have 64 bits.

Defined results: null texts and texts without words are classes of their own;
rows that repeat an id and its words are one document, rows that repeat an id
with other words are documents of their own; a null id gives a null class; ties
go to the smaller id; texts of any length are read whole; columns of any other
name, in any order, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, in_sieve, kept, lean, mix64, parts_of, stored, words_of

SHINGLE = 5
BANDS, ROWS = 36, 7
THRESHOLD = 0.8
_U = np.uint64
_UNIT = float(1 << 30)  # one mean arrival of a process of width 1
_NEVER = np.int64(1 << 62)


def shingles(texts: list[str | None], words: Memo) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Hashes of all shingles in text order, their number by text, and a fingerprint of each text's words (null without words)."""
    split = [words_of(t) for t in texts]
    lengths = np.array([*map(len, split)], np.int64)
    hashed = np.fromiter((h for w in split for h in map(words.__getitem__, w)), np.uint64, int(lengths.sum()))
    counts = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, (lengths > 0).astype(np.int64))
    fingerprints = [xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in split]
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashed, np.zeros(SHINGLE, _U)])
        starts = np.cumsum(lengths) - lengths
        first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        size = np.repeat(np.minimum(lengths, SHINGLE), counts)
        out = mix64(size.astype(_U))
        for k in range(SHINGLE):
            out = np.where(k < size, mix64(out * _U(0x9E3779B97F4A7C15) + padded[first + k]), out)
    return out, counts, fingerprints


def word_hashes() -> Memo:
    """Hashes of words, kept in a Python worker for its next tasks."""
    return kept(("word_hashes",), lambda: Memo(lambda w: xxhash.xxh3_64_intdigest(w), 200_000))


def bags(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: (text number, hash, weight)."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))


def signatures(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, slots: int, block: int = 100_000) -> np.ndarray:
    """The earliest arrival by text and slot; rows of texts without shingles hold the largest time.

    Shingles are taken `block` at a time, each against the earliest so far, so
    that a long text needs no more memory than many short ones.
    """
    out = np.full(n_texts * slots, _NEVER, np.int64)
    for at in range(0, len(text), block):
        own = slice(at, at + block)
        _arrivals(out, text[own], hashes[own], weights[own], n_texts, slots)
    return out.reshape(n_texts, slots)


def _arrivals(out: np.ndarray, text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, slots: int) -> None:
    """Moves the earliest arrivals `out` down by those of some shingles."""
    # one process for each interval that begins below the weight
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    which = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    owner, weight = text[which], weights[which]
    with np.errstate(over="ignore"):
        seed = mix64(hashes[which] + level.astype(_U) * _U(0xD1B54A32D192ED03))
    time = np.zeros(len(which), np.int64)
    drawn = 0
    while len(seed):
        ahead = int(min(64, max(1, 30_000 // len(seed))))
        with np.errstate(over="ignore"):
            counter = (np.arange(drawn, drawn + ahead) + 1).astype(_U) * _U(0x9E3779B97F4A7C15)
            bits = mix64(seed[:, None] + counter[None, :])
            more = mix64(bits ^ _U(0xA0761D6478BD642F))
        drawn += ahead
        uniform = ((bits >> _U(11)).astype(np.float64) + 1) / (1 << 53)
        gaps = (-np.log(uniform) * _UNIT).astype(np.int64) // width[:, None] + 1
        times = time[:, None] + np.cumsum(gaps, axis=1)
        slot = ((more >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
        inside = low[:, None] + ((more & _U(0xFFFFFFFF)).astype(np.int64) * width[:, None] >> 32) < weight[:, None]
        target = (owner[:, None] * slots + slot)[inside]
        np.minimum.at(out, target, times[inside])
        time = times[:, -1]
        latest = out.reshape(n_texts, slots).max(1)
        going = time < latest[owner]
        seed, time, owner, weight, low, width = seed[going], time[going], owner[going], weight[going], low[going], width[going]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key by text and band, of the band's slots and its number."""
    with np.errstate(over="ignore"):
        parts = signature.astype(_U).reshape(len(signature), bands, rows)
        key = np.broadcast_to(mix64((np.arange(bands) + 1).astype(_U)), parts.shape[:2]).copy()
        for k in range(rows):
            key = mix64(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, fingerprint, and band keys of rows (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        words = word_hashes()
        for batch in batches:
            for part in parts_of(batch):
                hashes, counts, prints = shingles(part.column("text").to_pylist(), words)
                keys = band_keys(signatures(*bags(hashes, counts), len(counts), bands * rows), bands, rows)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.binary()), listed], ["id", "print", "bands"])

    return docs.mapInArrow(lean(run), f"id {kind}, print binary, bands array<long>")


def _bagged(docs: DataFrame, bits: int = 32) -> DataFrame:
    """id and the sorted hashes of (shingle, occurrence) of rows (id, text).

    32 bits do to compare two texts; where all texts meet, 64 keep shingles apart.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        words = word_hashes()
        for batch in batches:
            for part in parts_of(batch):
                hashes, counts, _ = shingles(part.column("text").to_pylist(), words)
                text, found, weights = bags(hashes, counts)
                ends = np.cumsum(np.bincount(text, weights, len(counts)).astype(np.int64))
                with np.errstate(over="ignore"):
                    occurrence = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
                    elements = (mix64(np.repeat(found, weights) + occurrence.astype(_U) * _U(0xD1B54A32D192ED03)) >> _U(64 - bits)).astype(f"<u{bits // 8}")
                own = [np.sort(x).tobytes() for x in np.split(elements, ends[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own, pa.binary())], ["id", "bag"])

    return docs.mapInArrow(lean(run), f"id {kind}, bag binary")


def _sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of `docs` that may be in `ids`, found without moving a text."""
    return in_sieve(docs.select("id", "text"), ids, "known").filter("known").drop("known")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted multisets share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    if len(a) and len(b) and ((a[1:] == a[:-1]).any() or (b[1:] == b[:-1]).any()):  # equal hashes within a text
        va, na = np.unique(a, return_counts=True)
        vb, nb = np.unique(b, return_counts=True)
        _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        return int(np.minimum(na[ia], nb[ib]).sum())
    return int(same.sum())


def _verified(pairs: DataFrame, bagged: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = bagged.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    right = bagged.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                small, large = min(len(x), len(y)), max(len(x), len(y))
                shared = overlap(x, y) if small >= threshold * large else 0
                keep.append(shared >= threshold * (small + large - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "bag_a", "bag_b").mapInArrow(lean(run), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (a, b): the smallest id that is connected. By large and small stars."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # nodes that have no larger neighbour keep the edge to their least
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return stored(edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component"))


def _within(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Adds the component of `id`: its own where nothing links it."""
    if found is None:
        return rows.withColumn("component", F.col("id"))
    named = found.select(F.col("id").alias("other"), F.col("component").alias("c"))
    return rows.join(named, rows["id"] == F.col("other"), "left").withColumn("component", F.coalesce("c", "id")).drop("other", "c")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in two components."""
    ends = _within(_within(pairs.withColumnRenamed("b", "id"), found).withColumnRenamed("component", "cb").withColumnRenamed("id", "b").withColumnRenamed("a", "id"), found)
    return ends.filter("component <> cb").select(F.col("id").alias("a"), "b")


def _rest(buckets: DataFrame, found: DataFrame, bagged_of, done: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs across components among texts that share a bucket with another component."""
    placed = stored(_within(buckets, found))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    open_ = stored(placed.join(mixed, "bucket").select("id", "component").distinct())
    elements = stored(_exploded(bagged_of(open_.select("id"), 64)))
    # elements of one text only are as rare as can be and come first; they find no partner, so their number is all that counts.
    # Counts are combined before they move and then joined, where Spark splits the rows of a hot element
    texts = stored(elements.groupBy("element").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"))
    held = elements.join(texts, "element")
    own = Window.partitionBy("id")
    ranked = held.withColumn("place", F.row_number().over(own.orderBy("texts", "element")) + F.col("n") - F.count(F.lit(1)).over(own))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("id", "n", "element", "place")
    prefix = stored(prefix.join(open_, "id"))
    shared = stored(prefix.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("element"))
    # texts of more than `threshold` apart in size can't be similar: an element's texts meet by classes of size, in their own and the next
    size = F.floor(F.log("n") / -math.log(threshold)).cast("int")
    sides = stored(prefix.join(shared, "element").withColumn("size", size))
    left, right = (sides.select("element", "size", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "place", "component")]) for x in "ab")
    right = right.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    room = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    close = once & (F.col("component_a") != F.col("component_b")) & (room >= need) & (F.col("n_a") >= threshold * F.col("n_b"))
    pairs = left.join(right, (left["element"] == right["element"]) & (left["size"] == right["size"]) & close).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def _exploded(bagged: DataFrame) -> DataFrame:
    """(id, n, element) of bags of 64-bit elements, an element a row."""
    kind = bagged.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                own = [np.frombuffer(x, "<i8") for x in part.column("bag").to_pylist()]
                n = np.array([*map(len, own)], np.int32)
                rows = pa.array(np.repeat(np.arange(len(own)), n))
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), pa.array(np.repeat(n, n)), pa.array(np.concatenate(own) if len(own) else np.zeros(0, np.int64))], ["id", "n", "element"])

    return bagged.select("id", "bag").mapInArrow(lean(run), f"id {kind}, n int, element long")


def _classes(slim: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, bool, bool]:
    """(id, component) of rows (id, text), and whether ids are pairs (id, hash of the text), and whether a row occurs twice.

    Where rows of one id have different words, each text is a document of its
    own, and pairs tell them apart.
    """
    usable = slim.filter(F.col("id").isNotNull())
    signed = stored(_signed(usable, bands, rows))
    often = signed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("print")).alias("low"), F.max(F.xxhash64("print")).alias("high")).filter("n > 1")
    repeats, paired = often.agg(F.count(F.lit(1)) > 0, F.coalesce(F.max(F.col("low") < F.col("high")), F.lit(False))).first()
    if paired:
        slim = slim.withColumn("id", F.when(F.col("id").isNotNull(), F.struct(F.col("id"), F.xxhash64("text").alias("text"))))
        usable = slim.filter(F.col("id").isNotNull())
        signed = stored(_signed(usable, bands, rows))
    prints = signed.filter(F.col("print").isNotNull())
    kept = stored(prints.groupBy("print").agg(F.min(F.struct("id", "bands")).alias("first")).select("print", "first.id", "first.bands"))
    buckets = stored(kept.select("id", F.explode("bands").alias("bucket")))
    firsts = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").select("bucket", "a")
    together = buckets.join(firsts, "bucket")
    stars = stored(together.filter("id <> a").select("a", F.col("id").alias("b")).distinct())
    shared = stored(together.select("id", "bucket"))

    def bagged_of(ids: DataFrame, bits: int = 32) -> DataFrame:
        wanted = stored(ids.select("id").distinct())
        # rows of one id have the same words here, so any of them will do
        return stored(_bagged(_sieved(usable, wanted).join(wanted, "id", "left_semi").dropDuplicates(["id"]), bits))

    bagged = bagged_of(stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))))
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = [stored(_verified(first, bagged, threshold))]
    same = kept.select("print", F.col("id").alias("kept"))
    copies = prints.select("id", "print").join(same, "print").filter("id <> kept").select(F.col("kept").alias("a"), F.col("id").alias("b"))
    found = components(links[0])
    links.append(stored(_verified(_across(stars.join(first, ["a", "b"], "left_anti"), found), bagged, threshold)))
    found = components(reduce(DataFrame.union, links))
    links.append(stored(_verified(_rest(shared, found, bagged_of, stars, threshold), bagged, threshold)))
    found = components(reduce(DataFrame.union, [*links[:2], links[2]]))
    # copies hang on the text that stands for them
    of_copy = _within(copies.select(F.col("a").alias("id"), F.col("b").alias("copy")), found).select(F.col("copy").alias("id"), "component")
    named = stored(found.union(of_copy).groupBy("id").agg(F.min("component").alias("component")))
    return stored(_within(slim.select("id"), named)), bool(paired), bool(repeats)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The class of each row of `docs`: its id, class_id (the smallest id of the class), and class_size."""
    classes, paired, _ = _classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), threshold, bands, rows)
    sizes = stored(classes.groupBy("component").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1").withColumnRenamed("component", "of"))
    sized = classes.join(sizes, F.col("component") == F.col("of"), "left")
    size = F.when(F.col("component").isNotNull(), F.coalesce("class_size", F.lit(1)).cast("long"))
    own, of = (F.col("id.id"), F.col("component.id")) if paired else (F.col("id"), F.col("component"))
    return sized.select(own.alias(id_col), of.alias("class_id"), size.alias("class_size"))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class, that of the smallest id, all columns as they are; rows without an id stay.

    Texts that no class drops stay where they are, as far as the bitmap tells.
    """
    classes, paired, repeats = _classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), threshold, bands, rows)
    columns = docs.columns
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))) if paired else F.col(id_col)
    whole = docs.select(F.struct(*columns).alias("row"), key.alias("id"))
    dropped = stored(classes.filter(F.col("id") != F.col("component")).select("id").distinct())
    known = in_sieve(whole, dropped, "known")
    rest = known.filter("known").join(dropped, "id", "left_anti")
    out = known.filter("not known").select("id", "row").union(rest.select("id", "row"))
    if repeats:  # of equal ids and texts one row, the same on each run
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row"), F.to_json("row")))
        out = out.withColumn("place", place).filter((F.col("place") == 1) | F.col("id").isNull())
    return out.select("row.*")
