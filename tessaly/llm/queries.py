"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, mixing, url_reputation
from .common import table


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every whole text of `documents`."""
    from .bag_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` through the byte-level transducer and back."""
    import public_tokenizers as tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op3_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` as ids in a content-addressed store, and what its files say of each."""
    import public_tokenizers as tokenizers

    from .chunk_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages`, by rules and by the reputation that labelled documents shown there give its host."""
    from .url_reputation import judge_urls, labelled_pages

    pages = table(spark, sf_dir, "pages")
    out = judge_urls(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
    return out.withColumn("rate", F.round("rate", 9))


def op5_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of each row of `embeddings` whose id is divisible by 50."""
    from .bit_sliced import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every whole text of `documents`."""
    import public_tokenizers as tokenizers

    from .word_tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`, learned from two thirds of it."""
    from .language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of `documents`, learned from four fifths of `labels`."""
    from .toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, docs, table(spark, sf_dir, "labels"))


def op9_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over every whole text of `documents`."""
    from .robust_quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("row_key")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all `documents` by source weights 1, 2, 3 takes of each."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chunk_store": op3_chunk_store,
    "op4_url_reputation": op4_url_reputation,
    "op5_bit_sliced": op5_bit_sliced,
    "op6_prefix_counts": op6_prefix_counts,
    "op7_ppm_language": op7_ppm_language,
    "op8_subword_toxicity": op8_subword_toxicity,
    "op9_robust_quality": op9_robust_quality,
    "op10_source_mix": op10_source_mix,
}

ORACLES: dict[str, str] = {
    "op4_url_reputation": url_reputation.ORACLE,
    "op5_bit_sliced": bit_sliced.ORACLE,
    "op10_source_mix": mixing.ORACLE,
}
