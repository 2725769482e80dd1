"""Byte-level BPE encoding and decoding.

Encoding. A token sequence is the merge result of its bytes exactly when each
pair of neighbours is the merge result of its own bytes, so every prefix of a
piece has one encoding, which extends that of a shorter prefix by one token.
`Transducer` turns this into a finite-state transducer over bytes. A state
holds all ways to stand inside the next token: the last whole token and the
bytes since. A way dies when its bytes start no token, so the tokens before the
border on which all ways agree are final after a bounded lookahead and leave.
States and transitions are made when first met and forgotten together beyond a
limit, so memory is bounded. A piece's last byte only asks what is final there,
so it makes no state.

Short pieces, of which most are met once, run through the same transducer many
at a time: a byte of all of them is a step over flat arrays of their ways, which
are left undetermined as a state that isn't met again isn't worth making. At most
one way ends whole at a byte, since a prefix has one encoding. Texts are cut into
pieces many at a time, too, and each distinct piece of theirs is looked up once.

Decoding. Tokens become bytes, a bounded number at a time, and a UTF-8 automaton,
run from where the last character of such a part begins, tells whether it is
whole, so text leaves in pieces of bounded size even where a character spans
tokens.

Defined results: null is the empty text; an empty text has no ids; whitespace,
special strings and any other text are ordinary text. Rows are independent, so
repeated rows, null ids and extra columns change nothing; an empty table gives
an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, Recent, gathered, kept, lean, mix64, parts_of, small_batches, strings

_FAR = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain definition: join the neighbours of lowest rank, leftmost first, while any can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], _FAR), i) for i in range(len(parts) - 1))
        if rank == _FAR:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Bytes of one piece in, token ids out, by a transducer determinised as it is used.

    A way to stand inside the next token is one integer: the number of the
    last whole token and the node of the token trie reached since. A state is
    the tuple of all ways, the one that starts first in front.
    """

    NODE = 20  # bits of a trie node
    PAIRS = 1 << 19  # places of pairs met lately

    def __init__(self, ranks: dict[bytes, int], max_states: int = 60_000, max_pairs: int = 250_000):
        self.ranks, self.tokens = ranks, [*ranks]
        self.ids = [*ranks.values()]
        self.lengths = [*map(len, self.tokens)]
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]  # by node: the token that ends there, whether longer ones go on
        for k, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                self.inner[node] = True
                if (to := self.child.get(node << 8 | byte)) is None:
                    to = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = to
            self.ends[node] = k
        if len(self.ends) >> self.NODE:  # so that an edge's key is an int32 too
            raise ValueError("the token trie has too many nodes")
        self.max_states = max_states
        self.splits = Memo(self._split, 2 * len(ranks))
        self.fits = Memo(self._fits, max_pairs)
        self._reset()

    def _reset(self) -> None:
        start = (len(self.tokens) << self.NODE,)
        self.states, self.number, self.moves = [start], {start: 0}, {}

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose joining makes this one; None for a single byte, itself for one that no joining makes."""
        if (n := len(token)) == 1:
            return None
        rank = self.ranks[token]
        below = {t: r for i in range(n) for j in range(i + 1, n + 1) if (r := self.ranks.get(t := token[i:j], _FAR)) < rank}
        parts = merge(token, below)
        return (parts[0], parts[1]) if len(parts) == 2 else (token, b"")

    def made(self, token: bytes) -> bool:
        """Whether joining bytes ever gives this token."""
        return self.splits[token] != (token, b"")

    def _fits(self, pair: int) -> bool:
        """Whether the merge result of both tokens' bytes is these two tokens; of the second's, where there is no first.

        It isn't if, while both are built, some part that ends at the border
        and some part that begins there stand next to each other and would be
        joined before either grows. The parts are met by undoing the latest
        joining on either side.
        """
        first, second = pair >> self.NODE, pair & (1 << self.NODE) - 1
        right = self.tokens[second]
        if first == len(self.tokens):
            return self.made(right)
        left = self.tokens[first]
        ranks, splits = self.ranks, self.splits
        if not (self.made(left) and self.made(right)):
            return False
        next_join = _FAR  # the rank of the joining by which one of the two parts grows
        while True:
            if ranks.get(left + right, _FAR) < next_join:
                return False
            a, b = splits[left], splits[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and ranks[left] > ranks[right]):
                next_join, left = ranks[left], a[1]
            else:
                # at equal ranks the pair at the border lies further left and would win
                next_join, right = ranks[right] + 1, b[0]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the last token of the bytes up to here."""
        child, ends, inner, fits, bits = self.child, self.ends, self.inner, self.fits, self.NODE
        low = (1 << bits) - 1
        ways, whole = [], -1
        for way in self.states[state]:
            node = way & low
            if (to := child.get(node << 8 | byte)) is None:
                continue
            if whole < 0 and (token := ends[to]) >= 0 and fits[way - node | token]:
                whole = token
            if inner[to]:
                ways.append(way - node + to)
        if whole < 0:
            raise ValueError("the ranks lack a single byte")
        ways.append(whole << bits)
        target = (*ways,)
        if (k := self.number.get(target)) is None:
            k = self.number[target] = len(self.states)
            self.states.append(target)
        self.moves[state << 8 | byte] = out = (k, whole)
        return out

    def _final(self, state: int, byte: int) -> int:
        """The last token of a piece that ends with this byte: what ``_move`` gives, without a next state."""
        child, ends, fits, low = self.child, self.ends, self.fits, (1 << self.NODE) - 1
        for way in self.states[state]:
            node = way & low
            if (to := child.get(node << 8 | byte)) is not None and (token := ends[to]) >= 0 and fits[way - node | token]:
                return token
        raise ValueError("the ranks lack a single byte")

    def _chain(self, last: list[int], at: int) -> list[int]:
        """The tokens of the first `at` bytes, from the last to the first."""
        out = []
        while at > 0:
            out.append(token := last[at - 1])
            at -= self.lengths[token]
        return out

    def _agreed(self, last: list[int], state: int) -> int:
        """The last border at which all ways of a state cut."""
        low, borders = (1 << self.NODE) - 1, None
        for way in self.states[state]:
            node, depth = way & low, 0
            if node:
                depth = self.depths[node]
            at, own = len(last) - depth, {0}
            for token in self._chain(last, at):
                own.add(at)
                at -= self.lengths[token]
            borders = own if borders is None else borders & own
        return max(borders)

    @property
    def depths(self) -> list[int]:
        if not hasattr(self, "_depths"):
            self._depths = [0] * len(self.ends)
            for key, to in self.child.items():  # parents come first
                self._depths[to] = self._depths[key >> 8] + 1
        return self._depths

    @cached_property
    def flat(self) -> tuple[np.ndarray, ...]:
        """The trie as arrays: sorted keys of its edges and where they lead; by node the token and whether longer ones go on; by token its length and id."""
        keys, to = np.fromiter(self.child, np.int64, len(self.child)), np.fromiter(self.child.values(), np.int32, len(self.child))
        order = np.argsort(keys)
        return keys[order].astype(np.int32), to[order], np.array(self.ends, np.int32), np.array(self.inner, bool), np.array(self.lengths, np.int32), np.array(self.ids, np.int64)

    @cached_property
    def met(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs met lately, each at the place of its hash, and whether they fit."""
        return np.full(self.PAIRS, -1, np.int64), np.zeros(self.PAIRS, bool)

    def fits_all(self, pairs: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs; those met lately aren't computed again."""
        held, known = self.met
        place = (mix64(pairs.astype(np.uint64)) & np.uint64(self.PAIRS - 1)).astype(np.int64)
        out = known[place]
        if len(new := np.flatnonzero(held[place] != pairs)):
            asked, inverse = np.unique(pairs[new], return_inverse=True)
            found = np.fromiter(map(self._fits, asked.tolist()), bool, len(asked))[inverse]
            out[new] = found
            order = np.argsort(place[new])  # of pairs with one place, the same one stays in both arrays
            last = np.append(np.diff(place[new][order]) != 0, True)
            chosen = new[order[last]]
            held[place[chosen]], known[place[chosen]] = pairs[chosen], out[chosen]
        return out

    def encode_many(self, pieces: list[bytes], at_once: int = 1 << 14) -> list[tuple[int, ...]]:
        """The ids of each of many pieces, none empty, as ``encode`` gives them."""
        return [(*np.frombuffer(raw, np.int32).tolist(),) for raw in self.encode_raw(pieces, at_once)]

    @cached_property
    def whole(self) -> dict[bytes, bytes]:
        """The id of each token as bytes."""
        raw = np.array(self.ids, np.int32).tobytes()
        return {t: raw[4 * k : 4 * k + 4] for k, t in enumerate(self.tokens)}

    def encode_raw(self, pieces: list[bytes], at_once: int = 1 << 14) -> list[bytes]:
        """``encode_many`` with the ids of a piece as the bytes of 32-bit integers, a fraction of what objects of them hold."""
        out = [*map(self.whole.get, pieces)]
        order = sorted((i for i, ids in enumerate(out) if ids is None), key=lambda i: len(pieces[i]), reverse=True)
        for at in range(0, len(order), at_once):
            own = order[at : at + at_once]
            for i, ids in zip(own, self._run([pieces[i] for i in own]), strict=True):
                out[i] = ids
        return out

    def _run(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ids of pieces, longest first, a byte of all of them at a time."""
        keys, child, ends, inner, lengths, ids = self.flat
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(size) - size
        last = np.empty(len(data), np.int32)  # the last token of the bytes up to each
        going = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # by k: how many pieces have more than k bytes
        piece, token, node = np.arange(len(pieces)), np.full(len(pieces), len(self.tokens), np.int64), np.zeros(len(pieces), np.int64)
        for k in range(int(size[0])):
            key = node << 8 | data[first[piece] + k]
            edge = np.minimum(np.searchsorted(keys, key.astype(np.int32)), len(keys) - 1)
            alive = np.flatnonzero(keys[edge] == key)
            piece, token, node = piece[alive], token[alive], child[edge[alive]]
            end = ends[node]
            whole = np.flatnonzero(end >= 0)
            whole = whole[self.fits_all(token[whole] << self.NODE | end[whole])]
            if len(whole) != going[k]:
                raise ValueError("the ranks lack a single byte")
            last[first[piece[whole]] + k] = end[whole]
            on = np.flatnonzero(inner[node] & (piece < going[k + 1]))
            new = whole[piece[whole] < going[k + 1]]
            piece, token, node = np.concatenate([piece[on], piece[new]]), np.concatenate([token[on], end[new]]), np.concatenate([node[on].astype(np.int64), np.zeros(len(new), np.int64)])
        # from the last token of each piece to its first
        rest, own, rounds = size.copy(), np.arange(len(pieces)), []
        while len(own):
            rounds.append((own, found := last[first[own] + rest[own] - 1]))
            rest[own] -= lengths[found]
            own = own[rest[own] > 0]
        n = np.zeros(len(pieces), np.int64)
        for own, _ in rounds:
            n[own] += 1
        stop = np.cumsum(n)
        flat = np.empty(int(stop[-1]), np.int32)
        for back, (own, found) in enumerate(rounds, 1):
            flat[stop[own] - back] = ids[found]
        raw, stop = flat.tobytes(), (4 * stop).tolist()
        return (raw[a:b] for a, b in zip([0, *stop], stop, strict=False))

    def encode(self, piece: bytes, span: int = 1 << 14) -> list[int]:
        """The ids of one piece; a piece that is a token itself is that token. At most `span` bytes and a longest token wait."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        state, last, done, moves = 0, [], [], self.moves
        for byte in piece[:-1]:
            state, token = moves.get(state << 8 | byte) or self._move(state, byte)
            last.append(token)
            if len(last) >= span and (cut := self._agreed(last, state)):
                done += self._chain(last, cut)[::-1]
                del last[:cut]
        if piece:
            last.append(self._final(state, piece[-1]))
        done += self._chain(last, len(last))[::-1]
        return [*map(self.ids.__getitem__, done)]


#: What each byte may be followed by in UTF-8 (Unicode, table 3-7): state -> ranges of bytes and their next states.
#: 0 is between characters, 1 to 3 await so many free continuation bytes, 4 to 7 a restricted one, 8 is an error.
_UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)], 8: [],
}
ERROR = 8


def utf8_step(state: int, byte: int) -> int:
    """The automaton's next state."""
    return next((to for low, high, to in _UTF8[state] if low <= byte <= high), ERROR)


def utf8_resume(state: int, byte: int) -> int:
    """The next state of a decoder that goes on after an error: a byte that can't go on a character may begin one."""
    to = utf8_step(state, byte)
    return utf8_step(0, byte) if to == ERROR and state not in (0, ERROR) else to if state != ERROR else utf8_step(0, byte)


class Decoder:
    """Token ids in, bytes or text out, a bounded part at a time."""

    def __init__(self, ranks: dict[bytes, int], flush: int = 1 << 16):
        self.tokens = {i: t for t, i in ranks.items()}
        self.flush, self.at_once = flush, max(1, flush >> 4)

    @staticmethod
    def whole(data: bytes) -> int:
        """Up to where the bytes are whole characters or no UTF-8: all of them, or all but a last character that may go on."""
        for at in range(len(data) - 1, max(-1, len(data) - 5), -1):
            if data[at] & 0xC0 != 0x80:  # the automaton stands between characters here, whatever came before
                state = 0
                for byte in data[at:]:
                    state = utf8_resume(state, byte)
                return len(data) if state in (0, ERROR) else at
        return len(data)

    def stream(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Parts that each end where a character ends, as far as the bytes are UTF-8; the last holds what is left."""
        held, ids, bytes_of = b"", iter(ids), self.tokens.__getitem__
        while part := b"".join(map(bytes_of, islice(ids, self.at_once))):
            held += part
            if len(held) >= self.flush and (cut := self.whole(held)):
                yield held[:cut]
                held = held[cut:]
        if held:
            yield held

    def text(self, ids: Iterable[int]) -> str:
        """The text of whole documents; bytes that aren't UTF-8 become U+FFFD."""
        return "".join(x.decode("utf-8", "replace") for x in self.stream(ids))


def pieces_pattern(pattern: str):
    """The pattern compiled, with white space as Unicode has it (the library's own class differs in four controls)."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: The pattern that ``Cutter`` cuts by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Cutter:
    """Texts in, their pieces by WORDS out, over all characters at a time.

    A piece begins where the kind of characters changes: letters, numbers, white
    space, others. A space right before another kind belongs to its piece, other
    white space there is a piece of its own, and so is what of the white space
    stands before it; white space at a text's end stays whole. An apostrophe that
    begins a piece takes the letters of a contraction.
    """

    OTHER, LETTER, NUMBER, SPACE, END = range(5)

    def __init__(self):
        import regex

        self.kind = np.zeros(0x110000, np.uint8)
        place = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000))  # all but surrogates
        every = place.tobytes().decode("utf-32-le")
        for kind, name in ((self.LETTER, "L"), (self.NUMBER, "N"), (self.SPACE, "White_Space")):
            for run in regex.finditer(rf"\p{{{name}}}+", every):
                self.kind[place[run.start() : run.end()]] = kind

    def pieces(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The pieces of all texts in a row, each text's followed by one that stands for its end; where these are; and where the others are."""
        joined = "\n".join([*texts, ""])
        data = joined.encode()
        if len(data) == len(joined):
            codes = np.frombuffer(data, np.uint8)
        else:
            try:
                codes = np.frombuffer(joined.encode("latin-1"), np.uint8)
            except UnicodeEncodeError:
                codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kind[codes]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kind[ends] = self.END
        change, space = kind[1:] != kind[:-1], kind[:-1] == self.SPACE
        start = np.ones(len(codes), bool)
        np.logical_and(change, codes[:-1] != 0x20, out=start[1:])
        start[:-1] |= change & space & (kind[1:] != self.END)
        start[ends] = True
        start[ends[:-1] + 1] = True  # also behind a text's last space
        at = np.flatnonzero(start & (codes == 0x27))
        a, b = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
        one = np.isin(a, (0x73, 0x74, 0x6D, 0x64)) & (kind[at + 1] != self.END)
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 3] = True
        place = np.flatnonzero(start)
        last = kind[place] == self.END
        if len(data) != len(joined):
            more = codes >= 0x80
            if codes.dtype != np.uint8:
                more = more.astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            place = place + (np.cumsum(more, dtype=np.int64) - more)[place]
        offsets = np.append(place, len(data))
        found = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return found.dictionary_encode(), np.flatnonzero(last), np.flatnonzero(~last)


class Encoder:
    """Whole texts in, ids out: the pattern cuts pieces, short pieces are remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 150_000, longest: int = 48):
        self.transducer, self.find = Transducer(ranks), pieces_pattern(pattern).findall
        self.cutter = Cutter() if pattern == WORDS else None
        self.fresh: dict[bytes, bytes] = {}
        self.known = Recent(self._make, keep, longest)

    def _make(self, piece: bytes) -> bytes:
        return self.fresh.get(piece) or np.array(self.transducer.encode(piece), np.int32).tobytes()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, ends = self.encode_flat(texts)
        ids, ends = ids.tolist(), ends.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _pieces(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """What ``Cutter.pieces`` gives, by the pattern itself."""
        cut = [[*map(str.encode, self.find(t)), b"\n"] for t in texts]
        last = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))) - 1
        found = pa.array([*chain.from_iterable(cut)], pa.large_binary()).dictionary_encode()
        return found, last, np.delete(np.arange(len(found)), last)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end. A piece is looked up once; short ones that aren't remembered are encoded together."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        found, last, others = (self.cutter.pieces if self.cutter else self._pieces)(texts)
        distinct = strings(found.dictionary)
        known, old, longest = self.known, self.known.old, self.known.longest
        new = [p for p in distinct if p not in known and p not in old and len(p) <= longest]
        self.fresh = dict(zip(new, self.transducer.encode_raw(new), strict=True))
        raw = [*map(known.__getitem__, distinct)]
        self.fresh = {}
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        ids, own = gathered(np.frombuffer(b"".join(raw), np.int32), sizes, found.indices.to_numpy()[others])
        return ids, np.append(0, np.cumsum(own))[last - np.arange(len(last))]


def shared_coders(ranks_path: str, pattern: str) -> tuple[Encoder, Decoder, dict[int, str]]:
    """Both ways and the ids as text, made once in a Python worker and kept, with what they remember, for its next tasks."""

    def make():
        ranks = load_ranks(ranks_path)
        return Encoder(ranks, pattern), Decoder(ranks), {i: str(i) for i in ranks.values()}

    return kept(("byte_bpe", ranks_path, pattern), make)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode it again, and return digests of both.

    Columns: the id, n_tokens, ids_sha256, decoded_sha256, round_trip (whether
    decoding gave the text back) and, if asked for, ids (array of int). No
    shuffle: rows stay in the partitions they are read in.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder, decoder, names = shared_coders(ranks_path, pattern)
        for batch in (part for whole in batches for part in parts_of(whole, 1_000, 1_000_000)):
            n, digests, decoded, same, kept = [], [], [], [], []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                sha = hashlib.sha256()
                for part in decoder.stream(ids):
                    sha.update(part)
                decoded.append(sha.hexdigest())
                same.append(sha.digest() == hashlib.sha256(text.encode()).digest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            names_out = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                columns, names_out = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names_out, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return small_batches(slim).mapInArrow(lean(run), schema)


def decode_column(ids: Column, ranks_path: str) -> Column:
    """The text of an array of ids, as a column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(load_ranks(ranks_path))
        for part in parts:
            yield part.map(lambda x: None if x is None else decoder.text(x))

    return decode(ids)
