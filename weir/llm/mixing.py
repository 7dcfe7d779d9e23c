"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

``targets`` shares the words of all documents among the sources by weight; no
source takes more than ``most`` times its words, what is above is shared again
by weight among the others.

The documents of a source form one sequence in the order of a seeded hash. The
mix takes as many words of it as the target says, going round again where the
target is larger than the source. That stretch is cut into blocks of
``block_words`` words; the number of blocks is the source's exact quota. The
shards form a binary tree: a node splits its quotas between its two halves by a
draw from the multivariate hypergeometric distribution, seeded by the node, so
that each shard gets an exact number of blocks and each source is used up
exactly. A shard takes a range of a permutation of the source's blocks, so blocks
are disjoint, and orders its pieces by a hash.

Nothing but one quota per source is shared by all tasks (a mixture has a weight
per source, so it names them); a task finds the quotas of its shards by walking
down from the root. Draws and orders depend on the seed and the data alone, so
reruns and recomputed tasks agree.

A null source is a source of its own, last in order. Null and empty texts have
size 0 and are never taken. Rows that repeat an id are documents of their own.
An empty table gives an empty mix.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import RowNumber, RunningSum, ordered_scan, range_scan
from ..session import materialize
from .common import WORD, with_columns

_WORD = re.compile(WORD)
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 1 << 16
SHARD_BLOCKS = 256
_ORDER = 1 << 31
# Above so many blocks numpy's hypergeometric draw is not exact any more.
MAX_BLOCKS = 10**9


def word_count(text: str | Column = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source in words.

    The weights repeat over the sources in code point order, null last.
    """
    ranked = range_scan(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], [RowNumber("rank")])
    nth = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialize(ranked.select("source", "source_size", F.get(nth, ((F.col("rank") - 1) % len(weights)).cast("int")).alias("weight")))
    room = F.col("source_size") * float(most)
    # Words for each unit of weight; a source whose share is above its room leaves the sharing.
    level, full = 0.0, -1
    while True:
        capped = F.lit(False) if full < 0 else F.col("weight") * level > room
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, room).otherwise(0.0)).alias("room"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(capped.cast("int")).alias("full"),
        ).first()
        if not got["weight"] or got["full"] == full:
            break
        full, level = got["full"], (got["all"] - got["room"]) / got["weight"]
    return weighed.select("source", "source_size", F.least(F.col("weight") * level, room).alias("target"))


def split(quotas: np.ndarray, shards: int, first: int, last: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Quotas and offsets of the shards first to last (exclusive), found by walking down the tree."""
    total = int(quotas.sum())
    bounds = [total * i // shards for i in range(shards + 1)]
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    todo = [(0, shards, quotas, np.zeros_like(quotas))]
    while todo:
        lo, hi, own, offset = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            out[lo] = (own, offset)
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, bounds[mid] - bounds[lo], method="marginals")
        todo += [(lo, mid, left, offset), (mid, hi, own - left, offset + left)]
    return out


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1 by a four-round Feistel network, walking until the value is in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        a, b = x >> np.uint64(half), x & mask
        for k in range(4):
            h = (b + np.uint64((seed * 4 + k + 1) % (1 << 32))) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((h ^ (h >> np.uint64(29))) >> np.uint64(17) & mask)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        x = once(i.astype(np.uint64))
        while (out := x >= n).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def deal(spark, quotas: Sequence[int], shard_blocks: int, seed: int) -> DataFrame:
    """(source_no, block, shard, slot): which shard gets each block of each source."""
    total = sum(quotas)
    if total > MAX_BLOCKS:
        raise ValueError("too many blocks; choose a larger block_words")
    shards = max(1, math.ceil(total / shard_blocks))
    own = np.array(quotas, np.int64)

    def run(parts):
        for part in parts:
            for first in part["id"]:
                for shard, (take, offset) in split(own, shards, int(first), int(first) + 1, seed).items():
                    for s in np.flatnonzero(take):
                        at = np.arange(offset[s], offset[s] + take[s])
                        yield pd.DataFrame({"source_no": s, "block": permuted(at, int(own[s]), seed + int(s)), "shard": shard, "slot": at - offset[s]})

    return spark.range(shards).mapInPandas(run, "source_no long, block long, shard long, slot long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS,
    most: int = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their targets, and the pieces of the mix.

    Documents: doc_id, text_key, source, size, source_size, target, row_no. Pieces: row_no,
    shard, position, source_no, round, word_from, word_to (words of the document, 0-based,
    exclusive end). ``row_no`` = (source_no, start of the document in its source's order).
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")))
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    listed = sorted(aims.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))  # one row per source
    number = {r["source"]: i for i, r in enumerate(listed)}
    takes = [min(int(math.floor(r["target"] + 0.5)), most * r["source_size"]) for r in listed]
    spark = docs.sparkSession
    named = spark.createDataFrame(
        [(r["source"], number[r["source"]], r["source_size"], float(r["target"]), takes[number[r["source"]]]) for r in listed],
        "src string, source_no long, source_size long, target double, take long",
    )
    named = F.broadcast(named)  # one row per source of the mixture
    keyed = rows.join(named, rows["source"].eqNullSafe(named["src"])).drop("src")
    order = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(_ORDER)).alias("__order")
    keyed = keyed.select("*", order)
    # Blocks of the scan: a few for each partition, whatever the size of a source.
    width = max(1, _ORDER // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = ordered_scan(keyed, ["source_no"], ["__order", "doc_id", "text_key"], [RunningSum("stop", "size"), RowNumber("nth")], width)
    placed = materialize(placed.select("doc_id", "text_key", "source", "size", "source_size", "target", "take", "source_no", "nth", (F.col("stop") - F.col("size")).alias("start")))

    # Rounds: a document that lies in the stretch once more for each time the source is gone through.
    rounds = F.sequence(F.lit(0), F.lit(most - 1))
    pieces = placed.where("size > 0").select("doc_id", "text_key", "source_no", "nth", "start", "size", "take", "source_size", F.explode(rounds).alias("round"))
    pieces = pieces.withColumn("from", F.col("round") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), "take")).where(F.col("from") < F.col("to"))
    blocks = F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))
    pieces = pieces.select("*", F.explode(blocks).alias("block"))
    begin = F.greatest("from", F.col("block") * block_words)
    end = F.least("to", (F.col("block") + 1) * block_words)
    pieces = pieces.select("doc_id", "text_key", "source_no", "nth", "round", "block", (begin - F.col("from")).alias("word_from"), (end - F.col("from")).alias("word_to"))
    dealt = deal(spark, [math.ceil(t / block_words) for t in takes], shard_blocks, seed)
    mixed = pieces.join(dealt, ["source_no", "block"])
    position = F.xxhash64("shard", "source_no", "nth", "round", "word_from", F.lit(seed)).alias("position")
    return placed, mixed.select("doc_id", "text_key", "source_no", "nth", "shard", position, "round", "word_from", "word_to")


def taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each document with the words the mix takes of it, and its ``pieces`` by shard and position.

    A document has a piece per round and block it reaches into; one that is not taken has none.
    """
    piece = F.struct("shard", "position", "round", "word_from", "word_to")
    sums = pieces.groupBy("source_no", "nth").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = placed.join(sums, ["source_no", "nth"], "left")
    return joined.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).withColumn("pieces", F.coalesce("pieces", F.array().cast(sums.schema["pieces"].dataType)))


def apply_mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, cut to the words taken.

    A text taken whole stays as it is; a cut one keeps its words and what stands between
    them. ``n_chars``, if there, is counted anew.
    """
    _, pieces = mix(df, id_col, source, text, **options)
    # The pieces of one document and round are neighbours: together one stretch of words.
    spans = pieces.groupBy("doc_id", "text_key", "nth", "source_no", "round").agg(F.min("word_from").alias("__from"), F.max("word_to").alias("__to"))
    # Rows that repeat an id and a text are the same document; each has spans of its own.
    keyed = with_columns(df, __key=F.xxhash64(F.coalesce(F.col(text), F.lit(""))), __size=word_count(text)).dropDuplicates([id_col, "__key"])
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__span_key"), "__from", "__to")
    cut = keyed.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__span_key")))
    whole = (F.col("__from") == 0) & (F.col("__to") == F.col("__size"))
    part = _words_between(F.when(~whole, F.col(text)), F.col("__from"), F.col("__to"))
    out = cut.withColumn("__text", F.when(whole, F.col(text)).otherwise(part))
    new = {text: F.col("__text")} | ({"n_chars": F.length("__text").cast("long")} if "n_chars" in df.columns else {})
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


@F.pandas_udf(T.StringType())
def _words_between(texts: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    def cut(t, a, b):
        if t is None:
            return None
        ends = [m.span() for m in itertools.islice(_WORD.finditer(t), int(a), int(b))]
        return t[ends[0][0] : ends[-1][1]]

    return pd.Series([cut(t, a, b) for t, a, b in zip(texts, first, last)], dtype=object)
