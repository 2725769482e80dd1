"""The pipeline's stages on a small corpus: columns, order, and what each keeps."""

import hashlib
import random

import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessaly.llm import bpe


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    words = [f"word{chr(97 + k % 26)}{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vilescum", "badscum"])
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(w), "en", f"src{i % 3}", 0))
    rows += [(1000 + i, rows[1 + 5 * i][1], "en", "src0", 0) for i in range(5)] + [(2000, "too short", "en", "src0", 0), (2001, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "source_mix", "byte_bpe"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    assert not any(i % 5 == 0 and i < 400 for i in kept[0]) and len(kept[0]) >= 320
    assert not kept[1] & {2000, 2001}
    assert not kept[2] & set(range(1000, 1005)) and {1, 6, 11, 16, 21} <= kept[2]
    assert kept[3] <= kept[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert out.count() == docs.count() and out.filter("not round_trip").count() == 0


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    rows = out.collect()
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id for r in rows} <= {i for i in docs if i % 5 and i < 400}
    for r in rows[:50]:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_stages_of_odd_tables(spark, corpus, tmp_path):
    """Empty tables, columns in another order and of clashing names, repeated ids, nulls and a very long text."""
    long = " ".join(f"w{k}{chr(97 + k % 26)}" for k in range(60_000))
    plain = " ".join(f"term{k % 90}x{k}" for k in range(90))
    rows = [("k", plain, 7, "en", "s"), ("k", plain + " more", 7, "en", "s"), ("k", plain, 7, "en", "s"), ("k", long, 8, None, None), ("k", None, 9, "en", "s"), ("k", "", None, "en", None)]
    docs = spark.createDataFrame(rows, "id string, text string, doc_id long, lang string, source string").withColumn("row", F.lit(1)).withColumn("label", F.lit("x")).withColumn("component", F.lit(2))
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = kept.count()
            kept = stage(spark, kept, corpus)
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and kept.count() <= 3 * before
        out = corpus_pipeline.STAGES[-1][1](spark, kept, corpus)
        assert out.filter("not round_trip").count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, docs, corpus)
    assert sorted(len(r.text or "") for r in kept.collect()) == sorted([0, 0, len(plain), len(long)])
