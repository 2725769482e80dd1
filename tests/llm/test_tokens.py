"""Byte-level BPE, word token counts and the chunk store against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessaly.llm import bpe, chunk_store, common, word_tokens

RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizers.path("word_bpe_49k.json")
ODD = ["", "  \n\t ", "don't we've", "ÀÉ ß ﬀ é 中文 😀 <|endoftext|> x", "a" * 5000, "\x1c\x85 x", "12345 !!'s", "Σίσυφος ΟΔΟΣ"]
ROWS = [(1, "the cat sat", "x"), (2, None, "y"), (3, "", "z"), (3, "the cat sat", None), (None, "again 12!", "w"), (5, "long words " * 3000, "v"), (6, ODD[3], "u")]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_transducer_gives_the_merge_result():
    ranks = bpe.load_ranks(RANKS)
    run, rng, tokens = bpe.Transducer(ranks, max_states=200), random.Random(2), [*ranks]
    for _ in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        want = [ranks[piece]] if piece in ranks else [ranks[t] for t in bpe.merge(piece, ranks)]
        assert run.encode(piece, span=rng.choice([6, 50, 9999])) == want


def test_texts_encode_as_the_library_does(reference):
    encoder, decoder = bpe.Encoder(bpe.load_ranks(RANKS), tokenizers.PATTERN), bpe.Decoder(bpe.load_ranks(RANKS), flush=5)
    for text in ODD:
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert decoder.text(ids) == text


def test_utf8_automaton_accepts_what_python_does():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice((0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF)) for _ in range(rng.randint(0, 5)))
        state = 0
        for byte in data:
            state = bpe.utf8_step(state, byte)
        try:
            data.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        assert (state == 0) == good


def test_decoding_goes_on_after_bad_bytes():
    ranks = bpe.load_ranks(RANKS)
    rng = random.Random(2)
    for flush in (1, 2, 5, 1 << 16):
        decoder = bpe.Decoder(ranks, flush=flush)
        for _ in range(200):
            data = b"".join(rng.choice([b"a", "é".encode(), "中".encode(), "😀".encode(), b"\xff", b"\xe4", b"\x80", b"\xf0\x9f"]) for _ in range(12))
            ids = [ranks[bytes((x,))] for x in data]
            assert b"".join(decoder.stream(ids)) == data and decoder.text(ids) == data.decode("utf-8", "replace")


def test_short_texts_decode_without_the_automaton(monkeypatch):
    """A part shorter than the bound leaves as it is: a step of the automaton for each token was a fifth of the time."""
    ranks, steps = bpe.load_ranks(RANKS), []
    monkeypatch.setattr(bpe, "utf8_resume", lambda *a, resume=bpe.utf8_resume: steps.append(a) or resume(*a))
    text = "été 中文 😀 " * 400
    ids = bpe.Encoder(ranks, tokenizers.PATTERN).encode(text)
    assert b"".join(bpe.Decoder(ranks).stream(ids)) == text.encode() and not steps
    parts = [*bpe.Decoder(ranks, flush=64).stream(ids)]
    assert "".join(p.decode() for p in parts) == text and len(parts) > 50 and all(len(p) < 64 + 4 * 128 for p in parts)


def test_last_bytes_make_no_state():
    ranks = bpe.load_ranks(RANKS)
    run = bpe.Transducer(ranks)
    for end in range(0x61, 0x7B):
        piece = b" qzxjvkw" + bytes((end,))
        assert run.encode(piece) == [ranks[t] for t in bpe.merge(piece, ranks)]
    assert len(run.moves) == 8


def test_many_pieces_run_together():
    """Short pieces met once make no state; many of them give what each gives alone."""
    ranks, rng = bpe.load_ranks(RANKS), random.Random(5)
    run, tokens = bpe.Transducer(ranks), [*ranks]
    run.PAIRS = 64  # places that pairs share
    pieces = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))) for _ in range(1500)] + [bytes((x,)) for x in range(256)]
    want = [(ranks[p],) if p in ranks else tuple(ranks[t] for t in bpe.merge(p, ranks)) for p in pieces]
    assert run.encode_many(pieces) == want == run.encode_many(pieces, at_once=7)
    assert run.encode_many([]) == [] and not run.moves
    encoder = bpe.Encoder(ranks, tokenizers.PATTERN, keep=50)
    texts = [" ".join("".join(rng.choice("abeinrsté中") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(30)] + ODD
    one_by_one = [[i for piece in encoder.find(t) for i in run.encode(piece.encode())] for t in texts]
    assert encoder.encode_all(texts) == one_by_one
    assert len(encoder.transducer.states) < 10 and not encoder.fresh  # only the piece of 5,000 letters


def test_pieces_are_cut_all_at_once(reference):
    """The pattern run over each text and a lookup of each piece were most of the time that encoding took."""
    ranks, rng, asked = bpe.load_ranks(RANKS), random.Random(8), []

    class Counted(common.Recent):
        def __getitem__(self, key):
            asked.append(key)
            return self.get(key) or self.__missing__(key)

    encoder = bpe.Encoder(ranks, tokenizers.PATTERN)
    encoder.known, find = Counted(encoder._make, 1000, 48), encoder.find
    encoder.find = None
    texts = ["a wolf's hashhazza, wolf " * 400, "", "wolf \n", "hashhazza wolf's " * 300, "\n", "", "it'll"]
    assert encoder.encode_all(texts) == [reference.encode_ordinary(t) for t in texts] and len(asked) == len({*asked}) < 20
    assert encoder.encode_all([]) == [] and encoder.encode_all([""]) == [[]]
    for letters in ("ab'stmdrevl 12 \n\t.,", "ab'stmdrevl  \xa0é²½.!\x85\x1c", "ab'srel  \u2003中é１😀\u0301. "):
        for _ in range(20):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(200)]
            found, last, others = encoder.cutter.pieces(texts)
            pieces, begin = [x.decode() for x in found.to_pylist()], 0
            for text, end in zip(texts, last.tolist(), strict=True):
                assert pieces[begin:end] == find(text)
                begin = end + 1
            assert sorted([*last, *others]) == [*range(len(pieces))]
    other = bpe.Encoder(ranks, r"\S+|\s+")
    assert other.cutter is None and other.encode_all(["two words", "", "two 中文"]) == [[i for p in other.find(t) for i in other.transducer.encode(p.encode())] for t in ("two words", "", "two 中文")]


def test_recent_pieces_stay():
    made = []
    memo = common.Recent(lambda k: made.append(k) or (k,), 4, 3)
    for k in ["a", "b", "a", "c", "a", "d", "a", "long", "long", "e", "a"]:
        assert memo[k] == (k,) and len(memo) + len(memo.old) <= 4
    assert made.count("a") == 1 and made.count("long") == 2


def test_a_worker_gives_back_what_another_operator_kept():
    assert common.kept(("one",), lambda: 1) == 1 and common.kept(("one",), lambda: 2) == 1
    assert [*common.lean(lambda batches: iter([len(common._KEPT)]))([])] == [1]
    assert [*common.lean(lambda batches: iter([len(common._KEPT)]), keeps=False)([])] == [0]


def test_encode_documents(spark, docs, reference):
    found = sorted((tuple(r) for r in bpe.encode_documents(docs, RANKS, tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, text, _ in ROWS:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert found == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), RANKS, tokenizers.PATTERN).count() == 0
    both = bpe.encode_documents(docs, RANKS, tokenizers.PATTERN, with_ids=True)
    texts = {r.t for r in both.select(bpe.decode_column(both.ids, RANKS).alias("t")).collect()}
    assert texts == {t or "" for _, t, _ in ROWS}


def test_prefix_counts(library):
    model, rng = word_tokens.WordBpe(WORDS), random.Random(4)
    for text in ["Don't we've, I'll 'rabc we're 12.5", "Straße naïve!!'s", *ODD]:
        assert model.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        if model.is_plain(text) and len(text) < 200:
            table = model.table(text)
            counts = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
            assert [table.count(p) for p in range(len(text) + 1)] == counts
            for budget in range(6):
                assert table.longest_within(budget) == max(p for p, n in enumerate(counts) if n <= budget)
    letters = "ab'sreẹ́́ .,!1 İΣ漢한ᅡᆨ👩\u200d<|endoftext|>\n"
    varied = ["中文 words é here", "İstanbul ΣΑΣ", "x̸ ≮ क्षि काा", "a<|endoftext|>b !!<|startoftext|>", *("".join(rng.choice(letters) for _ in range(25)) for _ in range(60))]
    for text in varied:
        table, counts = model.table(text), [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert [table.count(p) for p in range(len(text) + 1)] == counts
        assert all(table.longest_within(b) == max(p for p, n in enumerate(counts) if n <= b) for b in range(max(counts) + 1))
    pieces = [bytes(rng.choice(b"abehrst.,") for _ in range(n)) for n in (0, 1, 2, 7, 20, 47, 48, 49, 200)]
    assert model.totals_of(pieces) == [model._total(p) for p in pieces]
    unspaced = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000))
    kept = word_tokens.longest_within(model, unspaced, 2048)
    assert len(library.encode(unspaced[:kept], add_special_tokens=False).ids) <= 2048 < len(library.encode(unspaced[: kept + 1], add_special_tokens=False).ids)
    for _ in range(300):
        text = "".join(rng.choice("abehrst'.,!1 éÀ\n") for _ in range(20))
        assert model.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_documents(docs, library):
    for r in word_tokens.count_tokens(docs, WORDS, limit=2).collect():
        texts = [t or "" for i, t, _ in ROWS if i == r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) in {(len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2) for t in texts}
    assert word_tokens.count_tokens(docs.limit(0), WORDS).count() == 0


def test_chunk_store_round_trip(spark, docs, library, tmp_path):
    path = str(tmp_path / "store")
    chunk_store.write_store(docs, path, WORDS, parts=3)
    found = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in chunk_store.read_digests(spark, path).collect()}
    streams = {}
    for i, text, _ in ROWS:
        streams.setdefault(i, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    start, sizes = 0, 0
    for i in sorted(streams, key=lambda x: (x is not None, x)):
        mine = sorted(f for f in found if f[0] == i)
        assert sorted(f[2:] for f in mine) == sorted((len(s), zlib.crc32(np.array(s, "<u4").tobytes())) for s in streams[i])
        for f in sorted(mine, key=lambda f: f[1]):
            assert f[1] == start
            start += f[2]
        sizes += len(streams[i])
    assert len(found) == sizes == len(ROWS)
    nodes = chunk_store.check_manifest(spark, path).collect()
    assert all(r.intact for r in nodes) and {(-1, 1), (0, 0)} <= {(r.part, r.level) for r in nodes}
    back = sorted(([r.doc_id, r.ids] for r in chunk_store.read_ids(spark, path).collect()), key=str)
    assert back == sorted(([i, s] for i, own in streams.items() for s in own), key=str)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert chunk_store.store_and_read(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("loss", ["recipe", "part", "order", "chunk", "manifest"])
def test_chunk_store_finds_losses(spark, tmp_path, monkeypatch, loss):
    monkeypatch.setattr(chunk_store, "FAN", 3)
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, f"some words {i} " * (1 + i % 40)) for i in range(60)], "doc_id long, text string")
    chunk_store.write_store(docs, path, WORDS, parts=4)
    assert chunk_store.read_digests(spark, path).count() == 60
    table = {"chunk": "chunks", "manifest": "manifest"}.get(loss, "recipes")
    rows = spark.read.parquet(f"{path}/{table}")
    if loss == "recipe":
        rows = rows.filter("id <> 17")
    elif loss == "part":
        rows = rows.filter("part <> 2")
    elif loss == "order":
        rows = rows.withColumn("position", F.when(F.col("position") < 2, 1 - F.col("position")).otherwise(F.col("position")))
    elif loss == "chunk":
        one = rows.agg(F.min("hash").alias("h")).first().h
        rows = rows.filter(F.col("hash") != F.lit(bytes(one)))
    else:
        rows = rows.filter("level <> 1")
    kept = rows.collect()
    spark.createDataFrame(kept, rows.schema).write.mode("overwrite").parquet(f"{path}/{table}")
    with pytest.raises(Exception, match="manifest|recipe"):
        chunk_store.read_digests(spark, path).collect()


def test_joined_checksums():
    parts = [b"abcd" * 7, b"", b"wxyz" * 100]
    shifts = {len(p): chunk_store._shift(len(p)) for p in parts}
    assert chunk_store.joined_crc([(zlib.crc32(p), len(p)) for p in parts], shifts) == zlib.crc32(b"".join(parts))


def test_a_batch_asks_for_each_word_once(library):
    """Lookups of every word, and of a word again with each mark behind it, were most of the time that encoding took."""

    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    ids, rng = chunk_store.WordIds(WORDS), random.Random(6)
    ids.known = Counted()
    texts = ["hashha wolf, wolf. wolf! Hashha " * 500, "wolf?! hashha\n" * 300]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, ids.type).tobytes() for t in texts]
    assert ids.batch(texts) == want and ids.known.asked < 30 and "wolf," not in ids.known
    letters = "abeinrsté .,!1 'tÀß×÷ªºµ#%&\n\t\r\xa0\xadÿ中İ"
    odd = ["", "...", "  x  ", *ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000))]
    assert [np.frombuffer(raw, ids.type).tolist() for raw in ids.batch(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]
    assert ids.batch([]) == []


def test_streams_are_cut_as_each_alone():
    rng = np.random.default_rng(7)
    streams = [rng.integers(0, most, n).astype("<u2") for most in (1, 5, 40_000) for n in (1, 63, 64, 65, 600, 5000, 20_000)]
    found = chunk_store.cuts_of(np.concatenate(streams), np.array([*map(len, streams)]))
    assert found == [chunk_store.cuts(s) for s in streams]
    for s, ends in zip(streams, found, strict=True):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(s) and sizes.max() <= chunk_store.MOST and (sizes[:-1] >= chunk_store.LEAST).all()
    assert max(map(len, found)) > 20 and chunk_store.cuts_of(np.zeros(0, "<u2"), np.zeros(0, int)) == []
