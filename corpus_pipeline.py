"""From raw documents to token ids: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
result to a Parquet folder below spark.checkpoint.dir and reads it back as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import bpe, lines, mixing, neardup, quality
from weir.llm.common import fold_of, small_batches, table
from weir.session import shared_dir, tune

# Entries of each cache of a BPE worker.
CACHED_WORDS = 10_000


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the input; the length of a changed text is counted anew."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more.

    Fitted on the labelled rows outside the held-out fold, as in the query op10_quality.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    stats = quality.statistics_of(docs.select("doc_id", "text")).drop("text")
    model = quality.fit(stats.join(labels, "doc_id"))
    return _same_columns(quality.score_texts(docs, model, out="__score").where(F.col("__score") >= 0.7), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines. No document is dropped."""
    small_batches(spark)
    return _same_columns(lines.deduplicate(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest id."""
    small_batches(spark)
    return _same_columns(neardup.deduplicate(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row each time a document is taken, cut to the words taken."""
    small_batches(spark)
    return _same_columns(mixing.apply_mix(docs), docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, packed as little-endian unsigned 32-bit integers, and their number.

    Workers keep small caches: executors still hold the memory of the stages before.
    """
    small_batches(spark)
    coded = bpe.encode(docs, entries=CACHED_WORDS)
    return coded.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

# Fitting, fingerprints, seeded draws and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tune(spark)
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
