"""Every registered opN_ query on a small corpus of odd rows: columns, one row a document, and what the contracts fix."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessaly.llm import bpe, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    words = {lang: [f"{lang}{''.join(rng.choice('abcdefgh') for _ in range(4))}" for _ in range(150)] for lang in ("en", "de")}
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(["en", "de"])
        w = [rng.choice(words[lang]) for _ in range(rng.randint(55, 90))]
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["vilescum", "badscum"])
        rows.append((i, " ".join(w), lang, f"s{i % 3}", 0))
        labels.append((i, 1, toxic))
    rows += [(300, rows[1][1], "en", None, 0), (301, None, None, None, None), (302, "", "en", "s0", 0), (303, "中文 — “quoted” <|endoftext|>", None, "s1", 0), (304, " ".join(words["en"] * 300), "en", "s1", 0), (305, "漢" * 20_000, None, "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.net/x", ""), (2, None, ""), (3, "https://example.net/en/1", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=4)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, {i: t or "" for i, t, *_ in rows}


def _rows(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def test_tokens(spark, tables):
    _, texts = tables
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    library = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    byte, store, counts = ({r.doc_id: r for r in _rows(spark, tables, n)} for n in ("op2_byte_bpe", "op3_chunk_store", "op6_prefix_counts"))
    assert set(byte) == set(store) == set(counts) == set(texts)
    start = 0
    for i in sorted(texts):
        ids = reference.encode_ordinary(texts[i])
        assert (byte[i].n_tokens, byte[i].ids_sha256, byte[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(texts[i].encode()), len(ids), len(ids) > 2048)
        ids = [*ids, 1]
        assert (store[i].start, store[i].n_tokens, store[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_predictions(spark, tables):
    _, texts = tables
    crc = lambda i: zlib.crc32(str(i).encode())
    for r in (rows := _rows(spark, tables, "op7_ppm_language")):
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id])))
    assert len(rows) == len(texts)
    for r in (rows := _rows(spark, tables, "op8_subword_toxicity")):
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert len(rows) == len(texts)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.predicted != (r.doc_id % 6 == 0) for r in held) <= 1


def test_classes_and_verdicts(spark, tables):
    _, texts = tables
    classes = {r.doc_id: (r.class_id, r.class_size) for r in _rows(spark, tables, "op1_bag_minhash")}
    assert set(classes) == set(texts) and classes[300] == classes[1] == (1, 2) and all(c == (i, 1) for i, c in classes.items() if i not in (1, 300))
    quality = {r.doc_id: r for r in _rows(spark, tables, "op9_robust_quality")}
    assert set(quality) == set(texts) and all(not r.kept for r in quality.values() if r.base_failed) and sum(r.kept for r in quality.values()) >= 290
    assert {(r.page_id, r.rule) for r in _rows(spark, tables, "op4_url_reputation")} == {(1, "net/"), (2, None), (3, "example.net/en/")}
    assert len(_rows(spark, tables, "op5_bit_sliced")) == 15
    mix = _rows(spark, tables, "op10_source_mix")
    assert len(mix) == len(texts) and all(0 <= r.taken <= 3 * r.size for r in mix)
