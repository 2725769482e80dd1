"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams, hashed into rows of one embedding
table; a text is the weighted mean of all rows of all its words; two softmax
weight vectors read that mean. Since both are linear, a word adds fixed amounts
to the text's logit and weight, so scoring remembers words up to a bound and
never meets the table again. A long word, as in text without spaces, is read to
its end in pieces and isn't remembered. Misspellings share most n-grams with the
words they come from.

Training is on the driver, over a sample bounded by `max_rows` rows, chosen by
hash of the id among labelled rows that aren't held out: the same rows on each
run, of any source, with their whole texts, kept as counts of words. Scoring
reads whole texts, in the partitions they come in, without a shuffle.

Defined results: a null or wordless text gets the score of the bias alone, as
does one that shares no row with the training texts; texts of any length are
read whole; equal texts get equal scores and other columns play no part; rows without a label are scored like any
other; of repeated labels of an id the largest counts; an empty table gives an
empty table; without training rows of both labels every score is the share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, small_batches

#: Characters that a word keeps: letters, digits and what misspellings put in their place.
_EDGE = ".,;:!?\"'()[]{}|*#%&$<>-_"
#: Words of more characters than `_LONG` aren't remembered; they are read `_PIECE` characters at a time.
_LONG, _PIECE = 62, 4_096


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def subwords(word: str, low: int, high: int) -> list[str]:
    """The word, with its borders marked, and its n-grams of `low` to `high` characters."""
    marked = f"<{word}>"
    return [marked, *(marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1))]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def crc32_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of many spans of bytes, a byte of all spans at a time."""
    size = end - begin
    crc, at, going, k = np.full(len(begin), 0xFFFFFFFF, np.uint32), begin.astype(np.int32), None, 0
    least = int(size.min()) if len(size) else 0
    for k in range(least):
        crc = _CRC[(crc ^ data[at + k]) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
    going, k = np.flatnonzero(size > least), least
    while len(going):
        own = crc[going]
        crc[going] = _CRC[(own ^ data[at[going] + k]) & np.uint32(0xFF)] ^ own >> np.uint32(8)
        k += 1
        going = going[size[going] > k]
    return ~crc


class Bag:
    """Texts as rows of the table: words lower-cased, stripped of marks, hashed."""

    def __init__(self, buckets: int, low: int = 3, high: int = 5):
        self.buckets, self.low, self.high = buckets, low, high
        self.rows = Memo(self._rows, 200_000)

    def _hashed(self, parts: Iterable[str]) -> np.ndarray:
        return np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) % self.buckets for s in parts], np.int32)

    def _rows(self, word: str) -> np.ndarray:
        return self._hashed(subwords(word, self.low, self.high))

    def pieces(self, word: str) -> Iterable[np.ndarray]:
        """The rows of a word; those of a long one a bounded piece of it at a time, each n-gram with the piece that it starts in, and not remembered."""
        if len(word) <= _LONG:
            yield self.rows[word]
            return
        marked = f"<{word}>"
        yield self._hashed([marked])
        for at in range(0, len(marked), _PIECE):
            piece = marked[at : at + _PIECE + self.high - 1]
            yield self._hashed(piece[i : i + n] for n in range(self.low, self.high + 1) for i in range(min(_PIECE, len(piece) - n + 1)))

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All rows of many words, word by word, and how many each has: the same as ``pieces`` gives, in one pass."""
        short = [w for w in words if len(w) <= _LONG]
        out, sizes = self._short_rows(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(short) == len(words):
            return out, sizes
        parts, n = [], []
        own = iter(np.split(out, np.cumsum(sizes)[:-1]) if short else [])
        for w in words:
            rows = next(own) if len(w) <= _LONG else np.concatenate([*self.pieces(w)])
            parts.append(rows)
            n.append(len(rows))
        return np.concatenate(parts), np.array(n, np.int64)

    def _short_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-8", "surrogatepass"), np.uint8)
        chars = np.flatnonzero(data & 0xC0 != 0x80)  # where characters begin
        begin_of = np.append(chars, len(data))
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        n_grams = [np.maximum(sizes - n + 1, 0) for n in range(self.low, self.high + 1)]
        counts = 1 + sum(n_grams)
        start_at = np.cumsum(counts) - counts
        where = [start_at]
        spans = [(begin_of[first], begin_of[first + sizes])]
        before = start_at + 1
        for n, own in zip(range(self.low, self.high + 1), n_grams, strict=True):
            inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            char = np.repeat(first, own) + inside
            where.append(np.repeat(before, own) + inside)
            spans.append((begin_of[char], begin_of[char + n]))
            before = before + own
        out = np.empty(int(counts.sum()), np.int32)
        out[np.concatenate(where)] = crc32_of(data, np.concatenate([a for a, _ in spans]), np.concatenate([b for _, b in spans])) % self.buckets
        return out, counts

    @staticmethod
    def words(text: str | None) -> list[str]:
        return [w for x in (text or "").lower().split() if (w := x.strip(_EDGE))]


class Model:
    """A trained classifier: what each row adds to the logit, and its weight in the mean. ``scores`` gives the chances of label 1."""

    def __init__(self, bag: Bag, logit_rows: np.ndarray, weight_rows: np.ndarray, bias: float, keep: int = 200_000):
        self.bag, self.logit_rows, self.weight_rows, self.bias, self.keep = bag, logit_rows, weight_rows, bias, keep
        self.both = np.stack([logit_rows, weight_rows], 1).astype(np.float64)
        self.place: dict[str, int] = {}
        self.values = np.zeros((0, 2))

    def _sums(self, words: list[str]) -> np.ndarray:
        """What each word adds to the logit and to the weight."""
        rows, n = self.bag.rows_of(words)
        return np.add.reduceat(self.both[rows], np.cumsum(n) - n) if len(words) else np.zeros((0, 2))

    def _long(self, word: str) -> np.ndarray:
        """The same of one long word, a bounded piece of it at a time."""
        return sum((self.both[rows].sum(0) for rows in self.bag.pieces(word)), np.zeros(2))

    def _learn(self, raws: list[str]) -> None:
        cores = [r.strip(_EDGE) for r in raws]
        new = [*{c: None for c in cores if c}]
        sums = dict(zip(new, range(len(new)), strict=True))
        table = np.concatenate([self._sums(new), np.zeros((1, 2))])  # the last is that of words without a letter
        self.place.update(zip(raws, range(len(self.values), len(self.values) + len(raws)), strict=True))
        self.values = np.concatenate([self.values, table[[sums.get(c, len(new)) for c in cores]]])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").lower().split() for t in texts]
        if len(self.place) > self.keep:
            self.place, self.values = {}, self.values[:0]
        place = self.place
        unknown = [w for w in {w for own in split for w in own} if w not in place]
        long = {w for w in unknown if len(w) > _LONG}
        new = [w for w in unknown if w not in long] if long else unknown
        for at in range(0, len(new), 2048):  # their n-grams are some MB of arrays
            self._learn(new[at : at + 2048])
        sums = np.zeros((len(texts), 2))
        for i, own in enumerate(split):
            known = [w for w in own if w not in long] if long else own
            if known:
                sums[i] = self.values[np.fromiter(map(place.__getitem__, known), np.int64, len(known))].sum(0)
            if len(known) < len(own):
                for w in own:
                    if w in long and (core := w.strip(_EDGE)):
                        sums[i] += self._long(core)
        z = self.bias + np.divide(sums[:, 0], sums[:, 1], out=np.zeros(len(texts)), where=sums[:, 1] > 0)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def column_scores(self, texts: pa.Array, rows: int = 512) -> np.ndarray:
        """The scores of an Arrow column, of which some rows at a time become strings."""
        return np.concatenate([np.zeros(0), *(self.scores(texts.slice(at, rows).to_pylist()) for at in range(0, len(texts), rows))])

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


class Corpus:
    """Texts as counts of words, and words as rows of the table: what training reads, in flat arrays."""

    def __init__(self, bag: Bag, texts: Iterable[str], least: int):
        known: dict[str, int] = {}
        found, counts, sizes = [], [], []
        for text in texts:
            own: dict[int, int] = {}
            for word in bag.words(text):
                k = known.setdefault(word, len(known))
                own[k] = own.get(k, 0) + 1
            found.append(np.fromiter(own, np.int32, len(own)))
            counts.append(np.fromiter(own.values(), np.float32, len(own)))
            sizes.append(len(own))
        self.word, self.count, self.first = _joined(found, np.int32), _joined(counts, np.float32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        del found, counts
        words = [*known]
        del known
        made = [bag.rows_of(words[at : at + 8192]) for at in range(0, len(words), 8192)]
        self.n = _joined([n for _, n in made], np.int64)
        self.rows = _joined([r for r, _ in made], np.int32)
        del made, words
        self._index()
        heard = np.zeros(bag.buckets, np.int64)
        for d in range(len(sizes)):
            heard[np.unique(self.rows_of(self.word[self.first[d] : self.first[d + 1]])[0])] += 1
        self.weight = np.where(heard >= least, 1 / np.sqrt(np.maximum(heard, 1)), 0).astype(np.float32)
        self.keep(self.weight > 0)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        mass, mass2 = (np.bincount(owner, self.weight[self.rows].astype(np.float64) ** k, len(self.n)) for k in (1, 2))
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.mass = np.bincount(text, self.count * mass[self.word], len(sizes))
        self.mass2 = np.bincount(text, self.count.astype(np.float64) ** 2 * mass2[self.word], len(sizes))

    def _index(self) -> None:
        self.at = np.concatenate([[0], np.cumsum(self.n)])

    def rows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of some words, in order, and how many each has."""
        n = self.n[words]
        return self.rows[np.repeat(self.at[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def keep(self, alive: np.ndarray) -> None:
        """Forgets all rows but those that are alive."""
        held = alive[self.rows]
        self.n = np.bincount(np.repeat(np.arange(len(self.n)), self.n)[held], minlength=len(self.n))
        self.rows = self.rows[held]
        self._index()

    def batch(self, chosen: np.ndarray, scale: float) -> tuple[np.ndarray, ...]:
        """(text, word, share) of each word of some texts, numbered within the batch, and (word, row) of each of its rows."""
        sizes = self.first[chosen + 1] - self.first[chosen]
        at = np.repeat(self.first[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        held = self.n[self.word[at]] > 0
        at, text = at[held], np.repeat(np.arange(len(chosen)), sizes)[held]
        words, word = np.unique(self.word[at], return_inverse=True)
        rows, n = self.rows_of(words)
        return text, word, self.count[at] * (scale / np.maximum(self.mass[chosen], 1e-9))[text], np.repeat(np.arange(len(words)), n), rows


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def gradients(table: np.ndarray, weights: np.ndarray, bias: np.ndarray, row_weight: np.ndarray, batch: tuple[np.ndarray, ...], y: np.ndarray, ease: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of a batch, the rows it has, and the mean gradients of those rows, the softmax weights and the bias; `ease` damps texts."""
    text, word, share, of_word, rows = batch
    n, n_words, size = len(y), int(word.max()) + 1 if len(word) else 0, table.shape[1]
    unique, row = np.unique(rows, return_inverse=True)
    weighted = table[unique] * row_weight[unique][:, None]
    mean = np.empty((n, size))
    for k in range(size):
        mean[:, k] = np.bincount(text, np.bincount(of_word, weighted[row, k], n_words)[word] * share, n)
    logits = mean @ weights + bias
    logits -= logits.max(1, keepdims=True)
    error = np.exp(logits)
    error /= error.sum(1, keepdims=True)
    loss = -float(np.log(error[np.arange(n), y] + 1e-12).sum())
    error[np.arange(n), y] -= 1
    error *= ease[:, None] / n
    back = error @ weights.T
    out = np.empty((len(unique), size))
    for k in range(size):
        out[:, k] = np.bincount(row, np.bincount(word, back[text, k] * share, n_words)[of_word], len(unique))
    return loss, unique, out * row_weight[unique][:, None], mean.T @ error, error.sum(0)


def train(texts: Iterable[str | None], labels: Iterable[int], buckets: int = 1 << 18, size: int = 4, epochs: int = 5, refits: int = 8, rate: float = 5.0, batch: int = 64, reach: float = 5.0, least: int = 8, doubt: float = 12.0, seed: int = 7) -> Model:
    """Embeddings and softmax weights together, from a random start, by stochastic gradient steps; exact copies count once.

    A row's weight in the mean is one over the root of the number of texts that
    hold it, so that chance moves all rows alike; rows of fewer than `least`
    texts have none. For `epochs` rounds each step also shrinks every row towards zero
    by `doubt` deviations of such chance, which leaves the rows that the labels
    need; `refits` rounds then move these alone, without shrinking. A marked
    word is a small share of a long text, so the mean is read at a scale at which
    the squared weights of a middling text's rows add up to `reach`.
    """
    bag = Bag(buckets)
    once = {(text or "", int(label)): None for text, label in zip(texts, labels, strict=True)}
    y = np.array([x for _, x in once], np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = np.log(np.array([1 - share, share]))
    if len(y) == 0 or y.min() == y.max():
        return Model(bag, np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), float(bias[1] - bias[0]))
    corpus = Corpus(bag, (t for t, _ in once), least)
    del once
    random = np.random.default_rng(seed)
    table = random.standard_normal((buckets, size)) * 0.01 * (corpus.weight > 0)[:, None]
    weights = random.standard_normal((size, 2))
    ratio = corpus.mass2 / np.maximum(corpus.mass, 1e-9) ** 2
    scale = float(np.sqrt(reach / max(np.median(ratio), 1e-9)))
    shrink = doubt * scale / max(float(corpus.mass.mean()), 1e-9) * float(np.sqrt(share * (1 - share))) / len(y)
    norm2 = scale**2 * ratio
    live = np.flatnonzero(corpus.weight)
    for epoch in range(epochs + refits):
        if 2 <= epoch <= epochs:
            alive = (table != 0).any(1)
            corpus.keep(alive)
            live = np.flatnonzero(alive)
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            round_, rounds = (epoch, epochs) if epoch < epochs else (epoch - epochs, refits)
            step = rate * (1 - (round_ + at / len(order)) / rounds)
            pull = float(np.abs(weights[:, 1] - weights[:, 0]).max())
            # short texts move each of their rows far, so far that steps would overshoot
            ease = np.minimum(1, 4 * batch / np.maximum(rate * pull**2 * norm2[chosen], 1e-9))
            _, rows, of_rows, of_weights, of_bias = gradients(table, weights, bias, corpus.weight, corpus.batch(chosen, scale), y[chosen], ease)
            table[rows] -= step * of_rows
            if epoch < epochs:
                held = table[live]
                table[live] = held * np.maximum(0, 1 - step * shrink * pull / np.maximum(np.sqrt(np.einsum("ij,ij->i", held, held)), 1e-12))[:, None]
            weights -= step * 0.01 * of_weights
            bias -= step * 0.1 * of_bias
    logit = (table @ (weights[:, 1] - weights[:, 0])) * scale * corpus.weight
    return Model(bag, logit.astype(np.float32), corpus.weight, float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int) -> tuple[list[str | None], list[int]]:
    """At most `max_rows` labelled rows that aren't held out, smallest hash of the id first, with their whole texts."""
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(~held_out(F.col("id"), 5, 0) & F.col("id").isNotNull())
    chosen = marks.filter(~held_out(F.col("id"), 5, 0)).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # the chosen ids are bounded by max_rows, so they can go to every task
    found = rows.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "text").limit(max_rows).select("text", "label").collect()
    return [r.text for r in found], [int(r.label) for r in found]


def score_toxicity(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 4_000) -> DataFrame:
    """Scores each whole text of `docs`, learning from `labelled_docs` and `labels`: the id, held_out, score, predicted."""
    model = train(*labelled_sample(labelled_docs, labels, label_col, id_col, text_col, max_rows))
    shared = docs.sparkSession.sparkContext.broadcast((model.logit_rows, model.weight_rows, model.bias))  # a fixed number of buckets
    buckets = model.bag.buckets
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        rows, weights, bias = shared.value
        own = Model(Bag(buckets), rows, weights, bias)
        for batch in batches:
            scores = own.column_scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col), 5, 0).alias("held"))
    return small_batches(slim).mapInArrow(lean(run, keeps=False), f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 4_000) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose whole text scores below one half."""
    model = train(*labelled_sample(labelled_docs, labels, label_col, id_col, text_col, max_rows))
    shared = docs.sparkSession.sparkContext.broadcast((model.logit_rows, model.weight_rows, model.bias))
    buckets, at = model.bag.buckets, docs.columns.index(text_col)

    def run(batches):
        rows, weights, bias = shared.value
        own = Model(Bag(buckets), rows, weights, bias)
        for batch in batches:
            yield batch.filter(pa.array(own.column_scores(batch.column(at)) < 0.5))

    return small_batches(docs).mapInArrow(lean(run, keeps=False), docs.schema)
