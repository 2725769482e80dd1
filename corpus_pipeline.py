"""A corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns rows with the columns of `documents`; the last returns what it
encoded. Between stages rows are written as Parquet and read again, so a lost
executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers as tokenizers
from tessaly.llm import bag_minhash, bpe, mixing, robust_quality, toxicity
from tessaly.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword toxicity, learned from the labelled rows among `docs`: rows scored one half or more go."""
    return toxicity.keep_clean(docs, docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers: rejected rows go."""
    return robust_quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: the row of the smallest id of each stays."""
    return bag_minhash.keep_firsts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3: whole rows, as often as their source's target asks."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level ids of each row's whole text, and their digests."""
    return bpe.encode_documents(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Training, signatures and tokenizers can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
