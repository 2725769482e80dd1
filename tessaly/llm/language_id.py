"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts, from order 0 to `ORDER`, with the
counts of what followed. A text's code length under a language is the sum over
its bytes of -log2 of the chance that the tree gives: in the longest context
that was met, the byte's count over count plus distinct followers (method C), else
the escape's share times the chance in the next shorter context, and at last one
in 256. Statistics are frozen after training. The shortest code names the
language, and the score is its posterior under equal priors.

Contexts begin anew at white space, each lower-cased word being read with a
space before it and one after, so a word's code lengths depend on nothing but the word. They
are remembered up to a bound.

Training is on the driver over a bounded sample: at most `max_rows` rows a
language, smallest hash of the row first, with their whole texts.
Predictions read whole texts, in the partitions they come in, without a shuffle.

Defined results: a null text, or one without letters, is ``und`` with score 0;
rows without a language can't be learned from but are predicted; of equal code
lengths the first language by code point wins; without training rows all is
``und``; equal texts have equal results; texts of any length are read whole;
columns of any other name play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

ORDER = 4
UNKNOWN = "und"


class Tree:
    """Counts of bytes by context, and the code lengths that they give once frozen."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def learn(self, word: bytes, times: int = 1) -> None:
        """Counts each byte of a word that begins with its context mark, in its longest context and all shorter ones."""
        for i in range(1, len(word)):
            byte = word[i]
            for k in range(min(self.order, i) + 1):
                self.counts[word[i - k : i]][byte] += times

    def frozen(self) -> dict[bytes, float]:
        """Code lengths in bits: of context plus byte, and of the escape from a context under the context itself followed by nothing.

        A byte is keyed by a leading 1 with context and byte, an escape by a leading 0 with the context.
        """
        out = {}
        for context, followers in self.counts.items():
            total = sum(followers.values())
            scale = total + len(followers)
            out[b"\0" + context] = float(np.log2(scale / len(followers)))
            for byte, n in followers.items():
                out[b"\1" + context + bytes((byte,))] = float(np.log2(scale / n))
        return out


def code_length(lengths: dict[bytes, float], word: bytes, order: int = ORDER) -> float:
    """Bits of a word's bytes after its context mark."""
    bits, get = 0.0, lengths.get
    for i in range(1, len(word)):
        for k in range(min(order, i), -1, -1):
            if (found := get(b"\1" + word[i - k : i + 1])) is not None:
                bits += found
                break
            bits += get(b"\0" + word[i - k : i], 0.0)
        else:
            bits += 8.0
    return bits


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


class Identifier:
    """Trained trees by language, as sorted arrays of contexts by order. ``identify`` gives (language, score) of each text."""

    def __init__(self, lengths: dict[str, dict[bytes, float]], order: int = ORDER, keep: int = 400_000):
        self.languages, self.order, self.keep = sorted(lengths), order, keep
        n = len(self.languages)
        self.bytes_of, self.escapes_of = [], []
        for k in range(order + 1):
            for into, mark, size in ((self.bytes_of, 1, k + 2), (self.escapes_of, 0, k + 1)):
                found: dict[int, list[float]] = {}
                for at, language in enumerate(self.languages):
                    for key, bits in lengths[language].items():
                        if key[0] == mark and len(key) == size:
                            found.setdefault(_number(key[1:]), [np.nan] * n)[at] = bits
                keys = np.array(sorted(found), np.int64)
                into.append((keys, np.array([found[x] for x in keys.tolist()]).reshape(len(keys), n)))
        self.known: dict[str, int] = {}
        self.bits = np.zeros((0, n))

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Rows of a table by key; not a number where it has none."""
        own, values = table
        if not len(own):
            return np.full((len(keys), values.shape[1]), np.nan)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        out = values[at]
        out[own[at] != keys] = np.nan
        return out

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, by the same rule as ``code_length``."""
        coded = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        sizes = np.array([*map(len, coded)])
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)  # how many bytes of its word stand before a byte
        total = np.zeros((len(data), len(self.languages)))
        open_ = np.ones(total.shape, bool)
        open_[place == 0] = False  # the context mark itself costs nothing
        grams = [data]
        for k in range(1, self.order + 1):  # the byte and k before it, as one number
            longer = grams[-1].copy()
            longer[k:] += data[:-k] << (8 * k)
            grams.append(longer)
        for k in range(self.order, -1, -1):
            where = np.flatnonzero((place >= max(k, 1)) & open_.any(1))
            if not len(where):
                continue
            bits = self._found(self.bytes_of[k], grams[k][where])
            own = open_[where]
            hit = own & ~np.isnan(bits)
            escape = np.nan_to_num(self._found(self.escapes_of[k], grams[k][where] >> 8)) if not hit.all() else 0.0
            total[where] += np.where(hit, bits, np.where(own, escape, 0.0))
            open_[where] = own & ~hit
        total[open_] += 8.0
        return np.add.reduceat(total, starts, axis=0)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [(t or "").lower().split() for t in texts]
        if len(self.known) > self.keep:
            self.known, self.bits = {}, self.bits[:0]
        new = [w for w in {w for words in split for w in words} if w not in self.known]
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            self.bits = np.concatenate([self.bits, self.code_lengths(part)]) if len(self.bits) else self.code_lengths(part)
        out, get = [], self.known.__getitem__
        for text, words in zip(texts, split, strict=True):
            if not words or not self.languages or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            bits = self.bits[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            best = int(bits.argmin())
            out.append((self.languages[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())))
        return out


def train(samples: Iterable[tuple[str, str]], order: int = ORDER) -> dict[str, dict[bytes, float]]:
    """Frozen code lengths by language, from (language, text)."""
    words: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for language, text in samples:
        own = words[language]
        for word in text.lower().split():
            own[word] += 1
    out = {}
    for language, own in words.items():
        tree = Tree(order)
        for word, times in own.items():
            tree.learn(b" " + word.encode("utf-8", "surrogatepass") + b" ", times)
        out[language] = tree.frozen()
    return out


def held_out(id_col: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 by 3; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int) -> list[tuple[str, str]]:
    """(language, text) of at most `max_rows` rows a language that aren't held out.

    The hashes of rows are ranked first, in parts of each language, so no
    language meets in one task and only the texts of chosen rows move.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("order", F.xxhash64("id", "text"))
    hashes = rows.select("lang", "order", F.pmod("order", F.lit(64)).alias("salt"))
    thinned = hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("order"))).filter(F.col("n") <= max_rows)
    chosen = thinned.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("n") <= max_rows)
    # equal rows are chosen together, once each
    found = rows.join(stored(chosen.select("lang", "order").distinct()), ["lang", "order"]).select("lang", "order", "text").dropDuplicates(["lang", "order"])
    return [(r.lang, r.text) for r in found.orderBy("lang", "order").collect()]


def identify_languages(docs: DataFrame, learned_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 300, order: int = ORDER) -> DataFrame:
    """The language of each whole text: the id, held_out, lang_pred, score."""
    lengths = train(sample(docs if learned_docs is None else learned_docs, id_col, text_col, lang_col, max_rows), order)
    shared = docs.sparkSession.sparkContext.broadcast(lengths)  # bounded by the sample
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = Identifier(shared.value, order)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [x for at in range(0, len(texts), 512) for x in own.identify(texts[at : at + 512])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held"))
    return slim.mapInArrow(lean(run, keeps=False), f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double")
