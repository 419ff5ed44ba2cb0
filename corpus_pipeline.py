"""From raw documents to token ids: language ID, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import bpe, exact_dedup, language_id, mixing, simhash
from textlake.llm.common import scratch
from textlake.llm.queries import tokenizer_path

#: Texts whose rank-order score is below this are in no known language; natural text scores 0.4 and more.
LEAST_SCORE = 0.3

#: Bytes of one Arrow batch of texts. By Spark's default it takes up to 64 MB, which a task holds several times: outside the
#: executor's heap, where buffers grow by doubling, and in its Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of BATCH_BYTES; a size that it has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or far from every language's profile, go."""
    small_batches(spark)
    trained = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, trained, LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the one with the smallest doc_id stays."""
    small_batches(spark)
    return simhash.deduplicate(docs, k=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated, at most twice as often as the largest; every document stays at least once."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: Fingerprints and language profiles are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
