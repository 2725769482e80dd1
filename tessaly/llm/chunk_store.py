"""Token ids as files: a content-addressed store of id chunks.

Each document's ids, with an end id, are cut where a rolling hash over the last
`WINDOW` ids falls on a boundary, so equal passages give equal chunks wherever
they stand. Three tables make the store:

* chunks: hash (SHA-256, 16 bytes), n_ids, data (little-endian ids); a chunk once,
  however often it occurs;
* recipes: part, position, start within the part, id, n_tokens, the chunk
  hashes in order, and root, the hash of those hashes; ascending by id;
* manifest: a Merkle tree over the recipes' roots. Level 0 hashes the roots of up
  to FAN neighbours of a part, each level above the hashes of up to FAN nodes,
  until a part has one; the last row, part -1, hashes all parts' tops. Nodes say
  how many documents and ids lie below them.

Only chunks are shuffled with data, once, to be stored once; texts never move.
Recipes are range-sorted by id, and a document's place among all ids is its
part's offset and its start within the part. Reading back builds the tree anew
from the recipes and fails where a node differs from the stored one or is
missing; then it recomputes each stored chunk's hash and checksum, checks each
recipe's root against the chunks it gets, and joins checksums, not data, to the
recipes. So a row lost, changed or moved anywhere is found.

Defined results: a null text is empty, and an empty text has the end id alone;
null ids come first; rows that repeat an id follow each other in an order fixed
by their ids; a text of any length is cut into chunks of bounded size; columns of
any other name play no part; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, drop_stored, ensure_checkpoint_dir, gathered, kept, lean, mix64, parts_of, stored, strings
from .word_tokens import MARKS, WordBpe

WINDOW, LEAST, MOST, MASK = 16, 64, 4096, 511
FAN = 1024
HASH_BYTES = 16


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:HASH_BYTES]


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end: boundaries of the rolling hash, at least LEAST and at most MOST ids apart."""
    return cuts_of(ids, np.array([len(ids)]))[0]


def cuts_of(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """``cuts`` of many streams that lie one behind the other. A window across their border ends less than LEAST ids from a stream's begin, where none is cut."""
    with np.errstate(over="ignore"):
        sums = np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)))
    rolling = sums[WINDOW:] - sums[:-WINDOW]
    marks = np.flatnonzero((mix64(rolling) & np.uint64(MASK)) == 0) + WINDOW + 1
    stops = np.cumsum(sizes)
    upto = np.searchsorted(marks, stops, "left").tolist()
    marks, found, at, first = marks.tolist(), [], 0, 0
    for stop, last in zip(stops.tolist(), upto, strict=True):
        own, begin = [], first
        for mark in [*marks[at:last], stop]:
            while mark - begin > MOST:
                begin += MOST
                own.append(begin - first)
            if mark - begin >= LEAST or mark == stop:
                if mark > begin:
                    own.append(mark - first)
                    begin = mark
        found.append(own)
        first, at = stop, last
    return found


class WordIds:
    """A text's ids as bytes, by the tokenizers library: over remembered words where words are independent, else over the whole text."""

    def __init__(self, path: str, keep: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = WordBpe(path, tables=False)
        self.library = self.model.library
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.closing = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.closing[i] = token.endswith(self.model.mark)
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def _learn(self, words: list[str]) -> None:
        """Ids of words: those of letters alone together, others one by one."""
        alone = [w for w in words if not w.isalpha()]
        self._learn_apart(alone)
        self._learn_letters([*filter(str.isalpha, words)] if alone else words)

    def _learn_apart(self, words: list[str]) -> None:
        for word in words:
            self.known[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, self.type).tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        """Many words of letters in one call of the library: each is one piece, and a piece's last token ends a word."""
        closing, known = self.closing, self.known
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.type)
            ends = (np.flatnonzero(closing[ids]) + 1).tolist()
            if len(ends) != len(part):
                self._learn_apart(part)
                continue
            raw, width, begin = ids.tobytes(), self.type.itemsize, 0
            for word, end in zip(part, ends, strict=True):
                known[word] = raw[begin * width : end * width]
                begin = end

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has: those of its letters and of the marks behind them, or of the whole word."""
        cores = pc.utf8_rtrim(words, MARKS)
        keys = pc.if_else(pc.utf8_is_alpha(cores), cores, words)
        n_marks = pc.subtract(pc.binary_length(words), pc.binary_length(keys)).to_numpy(zero_copy_only=False)
        keys = keys.dictionary_encode()
        marked = np.flatnonzero(n_marks)
        tails = [w[-n:] for w, n in zip(strings(words.take(pa.array(marked))), n_marks[marked].tolist(), strict=True)]
        number = {t: k for k, t in enumerate(dict.fromkeys(["", *tails]))}
        parts = [*strings(keys.dictionary), *number]
        if len(self.known) > self.keep:
            self.known.clear()
        raw = [*map(self.known.get, parts)]
        new = [k for k, ids in enumerate(raw) if ids is None]
        self._learn([parts[k] for k in new])
        for k in new:
            raw[k] = self.known[parts[k]]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.type.itemsize
        wanted = np.full((len(words), 2), len(keys.dictionary), np.int64)
        wanted[:, 0] = keys.indices.to_numpy()
        wanted[marked, 1] += np.fromiter(map(number.__getitem__, tails), np.int64, len(tails))
        ids, own = gathered(np.frombuffer(b"".join(raw), self.type), sizes, wanted.ravel())
        return ids, own.reshape(-1, 2).sum(axis=1)

    def batch(self, texts: list[str]) -> list[bytes]:
        plain = [*map(self.model.is_plain, texts)]
        # a plain text has no other white space, and an empty word has no ids
        words = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t for t, is_plain in zip(texts, plain, strict=True) if is_plain], pa.large_string())))
        each = words.flatten().dictionary_encode()
        ids, own = gathered(*self._distinct(each.dictionary), each.indices.to_numpy())
        ends = np.append(0, np.cumsum(own))[words.offsets.to_numpy()] * self.type.itemsize
        raw, ends = ids.tobytes(), ends.tolist()
        done = (raw[a:b] for a, b in zip(ends, ends[1:], strict=False))
        return [next(done) if is_plain else np.array(self.library.encode(t, add_special_tokens=False).ids, self.type).tobytes() for t, is_plain in zip(texts, plain, strict=True)]


def shared_ids(path: str) -> WordIds:
    """The encoder of a file, made once in a Python worker and kept, with the words it remembers, for the worker's next tasks."""
    return kept(("word_ids", path), lambda: WordIds(path))


def _staged(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = shared_ids(tokenizer_path)
        end = np.array([end_id], encoder.type).tobytes()
        width = encoder.type.itemsize
        seen: set[bytes] = set()
        for batch in batches:
            for part in parts_of(batch, 2_000, 8_000_000):
                n, hashes, data = [], [], []
                streams = [raw + end for raw in encoder.batch([t or "" for t in part.column("text").to_pylist()])]
                stops = cuts_of(np.frombuffer(b"".join(streams), encoder.type), np.fromiter(map(len, streams), np.int64, len(streams)) // width)
                for raw, ends in zip(streams, stops, strict=True):
                    begin, own, new = 0, [], []
                    for stop in ends:
                        chunk = raw[begin * width : stop * width]
                        own.append(key := _digest(chunk))
                        new.append(None if key in seen else chunk)
                        seen.add(key)
                        begin = stop
                    if len(seen) > 500_000:
                        seen.clear()
                    n.append(len(raw) // width)
                    hashes.append(own)
                    data.append(new)
                columns = [part.column("id"), pa.array(n, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.array(hashes, pa.list_(pa.binary())), pa.array(data, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "width", "hashes", "data"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lean(run), f"id {id_type}, n_tokens long, width int, hashes array<binary>, data array<binary>")


def _recipe_rows(batches):
    """Rows of one part in order, with their places, starts and roots."""
    from pyspark import TaskContext

    part, position, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, hashes = batch.column("n_tokens").to_pylist(), batch.column("hashes").to_pylist()
        starts = [start, *(start + np.cumsum(n)).tolist()] if n else [start]
        columns = {
            "part": pa.array([part] * len(n), pa.int32()), "position": pa.array(range(position, position + len(n)), pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "id": batch.column("id"),
            "n_tokens": batch.column("n_tokens"), "width": batch.column("width"), "hashes": batch.column("hashes"), "root": pa.array([_digest(b"".join(x)) for x in hashes], pa.binary()),
        }
        start, position = starts[-1], position + len(n)
        yield pa.RecordBatch.from_pydict(columns)


def _hashed_nodes(nodes: DataFrame, *keys: str) -> DataFrame:
    """One node for each group of `keys`: the hash of its members' hashes in order of `at`, and their sums; a group has FAN members at most."""
    members = F.sort_array(F.collect_list(F.struct("at", "hash")))
    own = F.unhex(F.sha2(F.unhex(F.array_join(F.transform(members, lambda x: F.hex(x["hash"])), "")), 256))
    return nodes.groupBy(*keys).agg(F.substring(own, 1, HASH_BYTES).alias("hash"), F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))


def merkle_tree(recipes: DataFrame, most: int) -> DataFrame:
    """All nodes (part, level, at, hash, docs, ids) over recipes (part, position, root, n_tokens), of at most `most` documents a part."""
    nodes = recipes.select("part", F.col("position").alias("at"), F.col("root").alias("hash"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("ids"))
    levels, level = [], 0
    while level == 0 or most > 1:
        grouped = _hashed_nodes(nodes.withColumn("up", F.floor(F.col("at") / FAN)), "part", "up")
        nodes = grouped.select("part", F.lit(level).alias("level"), F.col("up").alias("at"), "hash", "docs", "ids")
        levels.append(nodes)
        most, level = -(-most // FAN), level + 1
    # parts are few: as many as tasks wrote them
    tops = nodes.select(F.col("part").cast("long").alias("at"), "hash", "docs", "ids", F.lit(-1).alias("part"))
    top = _hashed_nodes(tops, "part").select("part", F.lit(level).alias("level"), F.lit(0).cast("long").alias("at"), "hash", "docs", "ids")
    return reduce(DataFrame.union, levels).union(top)


def _largest_part(recipes: DataFrame) -> int:
    return recipes.agg(F.coalesce(F.max("position"), F.lit(-1)) + 1).first()[0]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encodes every whole text and writes the store's tables below `path`."""
    staged = stored(_staged(docs, tokenizer_path, end_id, id_col, text_col))
    chunk = F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("data").alias("data"))).alias("chunk")
    chunks = staged.select("width", chunk).select(F.col("chunk.hash").alias("hash"), "width", F.col("chunk.data").alias("data")).filter(F.col("data").isNotNull())
    once = chunks.groupBy("hash").agg(F.first("data").alias("data"), F.first("width").alias("width"))
    once.select("hash", (F.octet_length("data") / F.col("width")).cast("int").alias("n_ids"), "width", "data").write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.select("id", "n_tokens", "width", "hashes")
    n = parts or max(8, docs.rdd.getNumPartitions())
    id_type = recipes.schema["id"].dataType.simpleString()
    ordered = recipes.repartitionByRange(n, F.col("id"), F.xxhash64("hashes")).sortWithinPartitions("id", F.xxhash64("hashes"), "hashes")
    ordered.mapInArrow(_recipe_rows, f"part int, position long, start long, id {id_type}, n_tokens long, width int, hashes array<binary>, root binary").write.parquet(f"{path}/recipes")
    written = docs.sparkSession.read.parquet(f"{path}/recipes")
    merkle_tree(written, _largest_part(written)).write.parquet(f"{path}/manifest")
    drop_stored(staged)


# CRC-32 of joined byte strings from those of the parts, by polynomials over GF(2) with bits reflected.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = b >> 1 ^ _POLY if b & 1 else b >> 1
    return out


def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    out, power, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            out = _times(power, out)
        power, n = _times(power, power), n >> 1
    return out


def joined_crc(parts: Iterable[tuple[int, int]], shifts: dict) -> int:
    """The checksum of byte strings in a row, from (checksum, length) of each."""
    crc = 0
    for own, length in parts:
        crc = _times(shifts[length], crc) ^ own if crc else own
    return crc


def _checked(batches):
    """Hash, length and checksum of each stored chunk, from its data."""
    for batch in batches:
        hashes, widths, data = (batch.column(c).to_pylist() for c in ("hash", "width", "data"))
        crcs, n = [], []
        for key, width, raw in zip(hashes, widths, data, strict=True):
            if _digest(raw) != key:
                raise ValueError(f"chunk {key.hex()} doesn't hold what its hash says")
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
            crcs.append(zlib.crc32(ids.tobytes()))
            n.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crcs, pa.int64()), pa.array(n, pa.int64())], ["hash", "crc", "n"])


def read_digests(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """A row a document, from the files alone: id, start among all ids, n_tokens, ids_crc32 over 32-bit ids.

    Raises ValueError where the manifest doesn't match the recipes.
    """
    broken = [r.part for r in check_manifest(spark, path).filter("not intact").limit(5).collect()]
    if broken:
        raise ValueError(f"the manifest doesn't match the recipes, as in parts {broken}")
    recipes = spark.read.parquet(f"{path}/recipes")
    sizes = spark.read.parquet(f"{path}/manifest").filter("part >= 0").groupBy("part").agg(F.max_by("ids", "level").alias("ids"))
    # a row a part, of which there are as many as tasks wrote them
    offsets = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_checked, "hash binary, crc long, n long")
    occurring = recipes.select("part", "position", F.posexplode("hashes").alias("k", "hash"))
    found = occurring.join(chunks, "hash").groupBy("part", "position").agg(F.sort_array(F.collect_list(F.struct("k", "crc", "n", "hash"))).alias("chunks"))
    id_type = recipes.schema["id"].dataType.simpleString()

    def run(batches):
        shifts = Memo(lambda n: _shift(4 * n))
        for batch in batches:
            crcs = []
            for n, root, chunks in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "root", "chunks")), strict=True):
                chunks = chunks or []
                if _digest(b"".join(c["hash"] for c in chunks)) != root or sum(c["n"] for c in chunks) != n:
                    raise ValueError("a recipe doesn't match the chunks it names")
                crcs.append(joined_crc(((c["crc"], c["n"]) for c in chunks), shifts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], [id_name, "start", "n_tokens", "ids_crc32"])

    placed = recipes.drop("hashes").join(found, ["part", "position"], "left").join(offsets, "part")
    return placed.select("id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "root", "chunks").mapInArrow(lean(run), f"`{id_name}` {id_type}, start long, n_tokens long, ids_crc32 long")


def check_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a node, of the stored tree or of the one that the recipes give: whether both have it, with equal hash and sums."""
    recipes, said = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    found = merkle_tree(recipes.select("part", "position", "root", "n_tokens"), _largest_part(recipes))
    keys = ["part", "level", "at"]
    same = F.col("s.node").eqNullSafe(F.col("f.node")) & F.col("s.node").isNotNull()
    pairs = (said.select(*keys, F.struct("hash", "docs", "ids").alias("node")).alias("s")).join(found.select(*keys, F.struct("hash", "docs", "ids").alias("node")).alias("f"), keys, "full")
    return pairs.select(*keys, same.alias("intact"))


def read_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None, id_name: str = "doc_id") -> DataFrame:
    """The ids themselves (array of int), of all documents or those whose id is in `wanted`."""
    recipes = spark.read.parquet(f"{path}/recipes")
    if wanted is not None:
        recipes = recipes.join(wanted.select(F.col(id_name).alias("id")).distinct(), "id", "left_semi")
    chunks = spark.read.parquet(f"{path}/chunks").select("hash", "width", "data")
    rows = recipes.select("part", "position", "id", F.posexplode("hashes").alias("k", "hash")).join(chunks, "hash")
    joined = rows.groupBy("part", "position", "id").agg(F.first("width").alias("width"), F.sort_array(F.collect_list(F.struct("k", "data"))).alias("chunks"))
    id_type = recipes.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["data"] for c in chunks), f"<u{w}").astype(np.int32) for w, chunks in zip(batch.column("width").to_pylist(), batch.column("chunks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], [id_name, "ids"])

    return joined.select("id", "width", "chunks").mapInArrow(lean(run), f"`{id_name}` {id_type}, ids array<int>")


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store, below the shared checkpoint folder if no path is given, and returns ``read_digests`` of it."""
    path = path or f"{ensure_checkpoint_dir(docs.sparkSession)}/chunk-store-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_digests(docs.sparkSession, path, id_col)
