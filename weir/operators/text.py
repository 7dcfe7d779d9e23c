"""Word streams: tokens, counts, top keywords, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scale import numbered_scan

# Rows of one word in one block stay below DOCS_PER_BLOCK times the words of a text.
DOCS_PER_BLOCK = 16384


def tokenize(df: DataFrame, text: str, keep: Sequence[str] = (), pattern: str = T.WHITESPACE) -> DataFrame:
    """One row (keep..., pos, word) per token."""
    return df.select(*keep, F.posexplode(T.words(text, pattern)).alias("pos", "word"))


def tokenize_charset(df: DataFrame, text: str, keep: Sequence[str] = (), delims: str = "\\s+") -> DataFrame:
    """As ``tokenize``, each character of ``delims`` being a delimiter."""
    return tokenize(df, text, keep, T.charset_pattern(delims))


def basket_words(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct words of a text without punctuation and symbols, case kept."""
    return df.select(*keep, F.array_distinct(T.words(T.strip_punctuation(text))).alias("words"))


def word_count(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias("cnt"))


def running_count(tokens: DataFrame, order: Sequence[str], word: str = "word", width: int = DOCS_PER_BLOCK) -> DataFrame:
    """Each arrival with the count of its word so far; ``order[0]`` is the text number."""
    return numbered_scan(tokens, [word], order, "cnt", width)


def top_keywords(texts: DataFrame, text: str, stop: DataFrame, k: int) -> DataFrame:
    """K most frequent lower-cased words; stop words stay, with count 0."""
    cleaned = texts.select(F.explode(T.words(T.strip_punctuation(text))).alias("word"))
    counts = word_count(cleaned.select(F.lower("word").alias("word")))
    marks = stop.select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    marked = counts.join(marks.withColumn("is_stop", F.lit(True)), "word", "left")
    zeroed = marked.select("word", F.when(F.col("is_stop"), F.lit(0)).otherwise(F.col("cnt")).cast("bigint").alias("cnt"))
    return top_entries(zeroed, "word", "cnt", k)


def top_entries(df: DataFrame, key: str, value: str, k: int = 4) -> DataFrame:
    """The k rows with the largest value; equal values in key order."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


def route(df: DataFrame, key: Sequence[str], probability: float, fraction: Column | None = None) -> DataFrame:
    """Tag each row with stream ``first`` (probability p) or ``second``.

    The choice is a function of the key, so a retried task routes alike.
    """
    if fraction is None:
        fraction = F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / 1_000_000.0
    return df.withColumn("stream", F.when(fraction < probability, "first").otherwise("second"))


def split_streams(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = routed.where(F.col("stream") == "first")
    second = routed.where(F.col("stream") == "second")
    return first.drop("stream"), second.drop("stream")


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Fan-in of named streams, tagged with their name."""
    tagged = [d.withColumn("stream", F.lit(name)) for name, d in streams.items()]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return out


def repartition_by_key(df: DataFrame, cols: Sequence[str], parts: int | None = None, salt: Column | None = None) -> DataFrame:
    """Fields grouping; ``salt`` spreads the rows of one key over several tasks."""
    keys = [F.col(c) for c in cols] + ([salt] if salt is not None else [])
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)
