"""Token counts at every prefix of a text, by dynamic programming over a BPE with word ends.

A prefix of a word has one encoding as the inside of a longer word and one as a
whole word, whose last symbol carries the word-end mark. Both follow from the
inside encodings of shorter prefixes: the last token is the one that fits the
token before it, where two tokens fit when they are the merge result of their
own symbols. So one pass over a word gives the exact count of tokens at each of
its prefixes. White space parts words for good, hence a text's table is its
words' running sum plus the table of the word in which a prefix ends, and
truncation or budget questions need no encoding.

The pass runs over all words at once that some texts add to those remembered:
the tables of all grow by one place at a time, as arrays. Words are remembered
up to a bound. Texts outside Latin-1, with controls or with special strings are
cut by the library's own normaliser and word rule; their pieces are counted by
the same pass, and their tables map places in the text to places in the pieces.
Only where a cut parts characters that compose, or a special string, is a piece
read again up to the cut.

A text of any length is read whole; one without spaces is one long piece, whose
table takes time in proportion to its length.

Defined results: null is the empty text, with no tokens; rows are independent,
so repeated rows, null ids and extra columns change nothing; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, kept, lean

#: Texts of these alone lower-case letter by letter, don't compose, and have no white space but " \t\n\r".
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*").fullmatch
#: Marks that a word may end in; an apostrophe could begin a piece with the letters before it, so it isn't one.
MARKS = ".,;:!?|*#%&$"
_FAR = 1 << 60
#: Totals that are remembered, bits of the table of pairs, and bytes beyond which a piece is read alone.
_KEEP, _PAIR_BITS, _LONG_PIECE = 800_000, 20, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordBpe:
    """The model of a tokenizer file: word rule, merges with a word-end mark, special strings."""

    def __init__(self, path: str, tables: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        self.mark = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in held["added_tokens"]]
        self.cut_specials = re.compile("|".join(map(re.escape, self.specials))).split if self.specials else None
        if not tables:
            return
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.made_by = {a + b: (a, b) for a, b in reversed([*self.rank])}
        split = next(p for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.made = Memo(lambda token: self.merged(token) == [token], 200_000)
        self._grow()
        self.fits = Memo(self._fits, 500_000)
        self.words = Memo(self._word, 50_000)
        self.totals: dict[str | bytes, int] = {}
        self._dense()

    def is_plain(self, text: str) -> bool:
        """Whether the words of the lower-cased text, apart, are encoded as the library encodes the text."""
        return PLAIN(text) is not None and not any(s in text for s in self.specials)

    def _grow(self) -> None:
        """The trie over bytes of all tokens; by node, the token that ends there inside a word and the one that ends a word."""
        self.back = {c: b for b, c in enumerate(self.letters)}
        special = {*self.specials}
        self.names = [t for t in self.vocab if t not in special and all(c in self.back for c in t)]
        self.child: dict[int, int] = {}
        self.inside, self.ending = [-1], [-1]
        for k, token in enumerate(self.names):
            closed = token.endswith(self.mark) and token != self.mark
            node = 0
            for letter in token[: -len(self.mark)] if closed else token:
                if (to := self.child.get(node << 8 | self.back[letter])) is None:
                    to = self.child[node << 8 | self.back[letter]] = len(self.inside)
                    self.inside.append(-1)
                    self.ending.append(-1)
                node = to
            (self.ending if closed else self.inside)[node] = k

    def _fits(self, pair: int) -> bool:
        """Whether the symbols of two tokens, of numbers pair >> 20 less 1 and the lower bits, merge to them; the second alone, where there is no first."""
        right = self.names[pair & 0xFFFFF]
        if not self.made[right]:
            return False
        if not pair >> 20:
            return True
        left = self.names[(pair >> 20) - 1]
        rank, made = self.rank, self.made_by
        if not self.made[left]:
            return False
        bound = _FAR
        while True:
            if rank.get((left, right), _FAR) < bound:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            ra, rb = rank[a] if a else -1, rank[b] if b else -1
            if ra > rb:
                bound, left = ra, a[1]
            else:
                # at equal ranks the pair at the border lies further left and is joined first
                bound, right = rb + 1, b[0]

    def merged(self, token: str) -> list[str]:
        """The plain definition: the symbols of a token, joined by lowest rank, leftmost first."""
        body, mark = (token[: -len(self.mark)], self.mark) if token.endswith(self.mark) and len(token) > len(self.mark) else (token, "")
        parts = [*body]
        parts[-1] += mark
        while len(parts) > 1:
            best, i = min((self.rank.get((parts[i], parts[i + 1]), _FAR), i) for i in range(len(parts) - 1))
            if best == _FAR:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _piece(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one piece, by code point."""
        return self._counts(piece.encode(), len(piece) < len(piece.encode()))

    def _counts(self, data: bytes, wide: bool = False) -> list[int]:
        """Token counts of the prefixes of a piece's bytes; if `wide`, only of those that end whole characters."""
        n, child, inside, ending, fits = len(data), self.child, self.inside, self.ending, self.fits
        last, counts, whole = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            before, count, node = (last[begin] + 1) << 20, counts[begin] + 1, 0
            for end in range(begin + 1, n + 1):
                if (node := child.get(node << 8 | data[end - 1])) is None:
                    break
                if (token := inside[node]) >= 0 and last[end] < 0 and fits[before | token]:
                    last[end], counts[end] = token, count
                if (token := ending[node]) >= 0 and not whole[end] and fits[before | token]:
                    whole[end] = count
        return [whole[e] for e in range(n + 1) if e == n or data[e] & 0xC0 != 0x80] if wide else whole

    def _total(self, data: bytes) -> int:
        """Tokens of a whole piece: the same pass, which keeps the inside counts and closes the word at its end alone."""
        n, child, inside, fits, closed = len(data), self.child.get, self.inside, self.fits, 0
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            before, node, end = (last[begin] + 1) << 20, 0, begin
            while end < n and (node := child(node << 8 | data[end])) is not None:
                end += 1
                if last[end] < 0 and (token := inside[node]) >= 0 and fits[before | token]:
                    last[end], counts[end] = token, counts[begin] + 1
                if end == n and not closed and (token := self.ending[node]) >= 0 and fits[before | token]:
                    closed = counts[begin] + 1
        return closed

    def _dense(self) -> None:
        """The trie as arrays, nodes with children first, so that one lookup moves many words."""
        inner = np.zeros(len(self.inside), bool)
        keys, to = np.fromiter(self.child, np.int64, len(self.child)), np.fromiter(self.child.values(), np.int64, len(self.child))
        inner[keys >> 8] = True
        inner[0] = True
        place = np.empty(len(inner), np.int32)
        place[np.argsort(~inner, kind="stable")] = np.arange(len(inner))
        self.moves = np.full((int(inner.sum()), 256), -1, np.int32)
        self.moves[place[keys >> 8], keys & 0xFF] = place[to]
        self.inside_at, self.ending_at = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
        self.inside_at[place], self.ending_at[place] = self.inside, self.ending
        self.pair_keys, self.pair_fits = np.full(1 << _PAIR_BITS, -1, np.int64), np.zeros(1 << _PAIR_BITS, bool)

    def _fit_all(self, pairs: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs; each slot of a table of fixed size remembers the last pair that fell there."""
        with np.errstate(over="ignore"):
            slot = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)
        out = self.pair_fits[slot]
        other = np.flatnonzero(self.pair_keys[slot] != pairs)
        if len(other):
            asked, first, back = np.unique(pairs[other], return_index=True, return_inverse=True)
            found = np.fromiter((self.fits[x] for x in asked.tolist()), bool, len(asked))
            out[other] = found[back]
            for at, key, value in zip(slot[other[first]].tolist(), asked.tolist(), found.tolist(), strict=True):
                self.pair_keys[at], self.pair_fits[at] = key, value
        return out

    def totals_of(self, pieces: list[bytes]) -> list[int]:
        """``_total`` of many pieces in one pass: the tables of all grow by the same place at a time."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.array([*map(len, pieces)], np.int64)
        for i in np.flatnonzero(sizes > _LONG_PIECE).tolist():
            out[i] = self._total(pieces[i])
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] <= _LONG_PIECE) & (sizes[order] > 0)]
        if not len(order):
            return out.tolist()
        size = sizes[order]
        data = np.frombuffer(b"\0".join([pieces[i] for i in order.tolist()]) + b"\0", np.uint8)
        start = np.cumsum(size + 1) - size - 1
        end = start + size
        last, counts, closed = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64), np.zeros(len(size), np.int64)
        inner = len(self.moves)
        for begin in range(int(size[0])):
            who = np.arange(int(np.searchsorted(-size, -begin, "left")))  # pieces longer than `begin`, which come first
            at = start[who] + begin
            before, count, node = (last[at] + 1) << 20, counts[at] + 1, np.zeros(len(who), np.int32)
            while len(who):
                node = self.moves[node, data[at]]
                at = at + 1
                alive = np.flatnonzero(node >= 0)
                if len(alive) < len(who):
                    who, at, before, count, node = who[alive], at[alive], before[alive], count[alive], node[alive]
                token, done = self.inside_at[node], at == end[who]
                asks = np.flatnonzero((token >= 0) & (last[at] < 0) & ~done)
                if len(asks):
                    asks = asks[self._fit_all(before[asks] | token[asks])]
                    last[at[asks]], counts[at[asks]] = token[asks], count[asks]
                if done.any():
                    token = self.ending_at[node]
                    asks = np.flatnonzero(done & (token >= 0) & (closed[who] == 0))
                    if len(asks):
                        asks = asks[self._fit_all(before[asks] | token[asks])]
                        closed[who[asks]] = count[asks]
                going = np.flatnonzero(~done & (node < inner))
                if len(going) < len(who):
                    who, at, before, count, node = who[going], at[going], before[going], count[going], node[going]
        out[order] = closed
        return out.tolist()

    def _learn(self, words: list[str | bytes]) -> None:
        """Remembers the totals of plain words and of other texts' pieces (bytes); letters are remembered apart from the marks behind them."""
        totals, parts = self.totals, {}
        for word in words:
            if isinstance(word, bytes):
                parts[word] = (word,)
                continue
            core = word.rstrip(MARKS)
            parts[word] = ((core, word[len(core) :]) if core != word else (core,)) if core.isalpha() else self.pieces(word)
        new = [*{p for own in parts.values() for p in own if p not in totals}]
        totals.update(zip(new, self.totals_of([p if isinstance(p, bytes) else p.encode() for p in new]), strict=True))
        for word, own in parts.items():
            if len(own) != 1:
                totals[word] = sum([totals[p] for p in own])

    def _word(self, word: str) -> tuple[int, ...]:
        """Token counts of the prefixes of one plain, lower-case word, by code point."""
        out, base = [0], 0
        for piece in self.pieces(word):
            counts = self._piece(piece)
            if len(piece) == 3 and piece[0] == "'":  # a contraction's own prefix is an apostrophe and a letter
                counts[2] = counts[1] + self._piece(piece[1])[1]
            out += [base + c for c in counts[1:]]
            base = out[-1]
        return (*out,)

    def normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def one_by_one(self, text: str) -> bytes:
        """The normal forms of a text's characters but white space, joined: the text's own form where nothing composes."""
        return "".join([self.normal(c) for c in text if not c.isspace()]).encode()

    def spelled(self, part: str) -> list[bytes]:
        """The pieces of a text without special strings, by the library's normaliser and word rule."""
        return [bytes(map(self.back.__getitem__, piece)) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.normal(part))]

    def _units(self, text: str) -> tuple[list, int]:
        """The words or pieces whose totals make a text's, and how many special strings it holds, which count 1 each."""
        if self.is_plain(text):
            return text.lower().split(), 0
        parts = self.cut_specials(text) if self.cut_specials else [text]
        return [p for part in parts for p in self.spelled(part)], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        if len(self.totals) > _KEEP:
            self.totals.clear()
        units = [*map(self._units, texts)]
        known = self.totals
        self._learn([w for w in {w for own, _ in units for w in own} if w not in known])
        return [sum(map(known.__getitem__, own)) + n for own, n in units]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.counts([text])[0]

    def table(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)


def shared_model(path: str) -> WordBpe:
    """The model of a file, made once in a Python worker and kept, with the words it remembers, for the worker's next tasks."""
    return kept(("word_bpe", path), lambda: WordBpe(path))


def _joins_before(c: str) -> bool:
    """Whether a character may compose with the one before it: marks, and the vowels and finals of Hangul."""
    return "\u0300" <= c and (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")


class PrefixTable:
    """The token count of each prefix of a text: running sums where its pieces end, and tables inside the pieces that are asked about.

    A piece's table gives, by code points of the text, the tokens of its part
    up to there. Where a cut parts characters that the library would compose,
    or lies in a special string, that one piece is read again up to the cut.
    """

    def __init__(self, model: WordBpe, text: str):
        self.model, self.text, self.length = model, text, len(text)
        self.begin, self.kinds = [], []  # where a piece begins, and what it is: a word, bytes, or a special string
        if model.is_plain(text):
            found = [*re.finditer(r"[^ \t\n\r]+", text)]
            self.begin, self.kinds = [m.start() for m in found], [m[0].lower() for m in found]
        else:
            self._pieces()
        model._learn([k for k in {x for k in self.kinds for x in (k if isinstance(k, tuple) else (k,))} if k is not None and k not in model.totals])
        self.sums = [*accumulate((1 if k is None else sum(map(model.totals.__getitem__, k if isinstance(k, tuple) else (k,))) for k in self.kinds), initial=0)]
        self.tables: dict[int, np.ndarray] = {}

    def _pieces(self) -> None:
        from tokenizers import PreTokenizedString

        at, model = 0, self.model
        parts = re.split("(" + "|".join(map(re.escape, model.specials)) + ")", self.text) if model.specials else [self.text]
        for k, part in enumerate(parts):
            if k % 2:
                self.begin.append(at)
                self.kinds.append(None)
            elif part:
                held = PreTokenizedString(part)
                if model.library.normalizer:
                    held.normalize(model.library.normalizer.normalize)
                model.library.pre_tokenizer.pre_tokenize(held)
                end, apart = 0, True
                for piece, (start, stop), _ in held.get_splits(offset_referential="original", offset_type="char"):
                    spelled, before = bytes(map(model.back.__getitem__, piece)), apart
                    apart = model.one_by_one(part[start:stop]) == spelled
                    # pieces that share a character's form, or composed across their border, stay together
                    if start < end or (start == end > 0 and _joins_before(part[start]) and not (before and apart)):
                        apart = False
                        self.kinds[-1] = (*(self.kinds[-1] if isinstance(self.kinds[-1], tuple) else (self.kinds[-1],)), spelled)
                    else:
                        self.begin.append(at + start)
                        self.kinds.append(spelled)
                    end = max(end, stop)
            at += len(part)

    def _again(self, k: int, prefix: int) -> int:
        """Tokens from piece `k` up to a cut, read anew; from the piece before a special string, as a cut string is none."""
        while k and self.kinds[k] is None and self.kinds[k - 1] is not None:
            k -= 1
        return self.sums[k] + self.model.count(self.text[self.begin[k] : prefix])

    def _table(self, k: int) -> np.ndarray:
        """Tokens of all prefixes of piece `k`, from the empty one, up to the next piece; -1 where it must be read again."""
        if k in self.tables:
            return self.tables[k]
        stop, kind, model = self.begin[k + 1] if k + 1 < len(self.begin) else self.length, self.kinds[k], self.model
        own = self.text[self.begin[k] : stop]
        if kind is None:
            out = np.full(len(own) + 1, -1, np.int64)
            out[0], out[len(next(s for s in model.specials if own.startswith(s))) :] = 0, 1
        elif isinstance(kind, tuple):
            out = np.full(len(own) + 1, -1, np.int64)
            out[0] = 0
        elif isinstance(kind, str):
            counts = model.words[kind]
            out = np.array([*counts, *[counts[-1]] * (len(own) + 1 - len(counts))], np.int64)
        else:
            whole = np.array(model._counts(kind), np.int64)
            normal = model.normal
            sizes = np.array([0 if c.isspace() else len(normal(c).encode()) for c in own], np.int64)
            upto = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(kind))
            out = whole[upto]
            # where characters may compose, sizes aren't those of single ones
            if model.one_by_one(own) != kind:
                out[1:] = -1
            if kind[:1] == b"'" and len(kind) == 3:  # a contraction's own prefix is an apostrophe and a letter
                out[1:len(own)] = -1
        self.tables[k] = out
        return out

    def count(self, prefix: int) -> int:
        """Tokens of the first `prefix` code points."""
        k = bisect_right(self.begin, prefix - 1) - 1
        if k < 0:
            return 0
        inside = int(self._table(k)[prefix - self.begin[k]])
        return self.sums[k] + inside if inside >= 0 else self._again(k, prefix)

    def longest_within(self, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        if self.sums[-1] <= budget:
            return self.length
        # tokens at the ends of pieces never fall, and a cut piece has one token at least
        for k in range(bisect_right(self.sums, budget) - 1, -1, -1):
            table = self._table(k)
            for inside in range(len(table) - 1, 0, -1):
                found = self.sums[k] + int(table[inside]) if table[inside] >= 0 else self._again(k, self.begin[k] + inside)
                if found <= budget:
                    return self.begin[k] + inside
        return self.begin[0] if self.begin else self.length


def longest_within(model: WordBpe, text: str, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    return model.table(text).longest_within(budget)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact counts of whole texts: the id, n_bytes, n_tokens, over_limit, and kept_chars, the longest prefix within `limit`."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared_model(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [n for at in range(0, len(texts), 1024) for n in model.counts(texts[at : at + 1024])]
            kept = [len(t) if n <= limit else longest_within(model, t, limit) for t, n in zip(texts, counts, strict=True)]
            columns = [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lean(run), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")
