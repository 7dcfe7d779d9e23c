"""Pattern counts and the change log of maximal patterns over a basket stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import patterns as P
from ..scale import parallelism
from ..session import materialize, run_dir
from .buckets import BucketTable
from .runs import drain_batches, drain_updates
from .versions import VersionedTable

CHANGES = T.StructType([
    T.StructField("pattern", T.ArrayType(T.IntegerType())), T.StructField("is_maximal", T.BooleanType()), T.StructField("cnt", T.LongType()),
])


def net_baskets(baskets: DataFrame) -> DataFrame:
    """Streaming sum of +1 and -1 per distinct basket; the sums live in the state store.

    The state grows with distinct baskets, not with their subsets.
    """
    return baskets.groupBy("ids").agg(F.sum(F.when(F.col("is_add"), 1).otherwise(-1)).alias("n"))


def pattern_counts(baskets: DataFrame, folder: str | None = None) -> DataFrame:
    """Counts of a basket stream after all its input; positive ones only."""
    return P.pattern_counts(drain_updates(net_baskets(baskets), ["ids"], "pattern-counts", folder).where("n <> 0"))


ENTRY = T.StructType([
    T.StructField("pattern", T.ArrayType(T.IntegerType())), T.StructField("cnt", T.LongType()), T.StructField("refs", T.LongType()),
])


def advance(before: DataFrame, deltas: DataFrame, threshold: int) -> DataFrame:
    """Entries after count deltas, with what they were: (pattern, cnt, refs, was_cnt, was_refs).

    ``before`` holds the known entries (pattern, cnt, refs) of all patterns that may change,
    ``deltas`` (pattern, d). A pattern whose count passes the threshold adds one
    reference to each of its proper subsets, one that falls below it takes one back.
    """
    zero = F.lit(0).cast("bigint")
    old = before.select("pattern", F.col("cnt").alias("was_cnt"), F.col("refs").alias("was_refs"))
    counted = materialize(old.join(deltas, "pattern", "full_outer").select(
        "pattern", F.coalesce("was_cnt", zero).alias("was_cnt"), F.coalesce("was_refs", zero).alias("was_refs"),
        (F.coalesce("was_cnt", zero) + F.coalesce("d", zero)).alias("cnt"),
    ))
    step = F.when(F.col("cnt") >= threshold, 1).otherwise(-1)
    crossed = counted.where((F.col("was_cnt") >= threshold) != (F.col("cnt") >= threshold)).select("pattern", step.alias("step"))
    calls = P.expand_subsets(crossed, "pattern", ["step"], proper=True)
    refs = calls.groupBy("pattern").agg(F.sum("step").cast("bigint").alias("r"))
    # A subset of a basket's subset is a subset of the basket, but its own count may not have moved.
    both = counted.join(refs, "pattern", "full_outer")
    return both.select(
        "pattern", F.coalesce("cnt", zero).alias("cnt"), (F.coalesce("was_refs", zero) + F.coalesce("r", zero)).alias("refs"),
        F.coalesce("was_cnt", zero).alias("was_cnt"), F.coalesce("was_refs", zero).alias("was_refs"),
    )


def maximal_changelog(baskets: DataFrame, threshold: int, folder: str | None = None, work: Callable[[int, int], None] | None = None) -> DataFrame:
    """(pattern, is_maximal, cnt, batch_id): state changes settled per micro-batch.

    The state has an entry per pattern: its net count and the number of frequent proper
    supersets. A batch expands its own baskets only, reads and rewrites the buckets of
    their subsets, and sends references where counts pass the threshold, so its work
    follows the batch. An entry whose count and references are both 0 leaves. ``work`` is told
    the batch id and the number of entries the batch looked at.
    """
    spark = baskets.sparkSession
    folder = folder or run_dir(spark, "changelog")
    state = BucketTable(f"{folder}/entries", ENTRY, ["pattern"])
    changes = VersionedTable(f"{folder}/changes", CHANGES)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        net = batch.groupBy("ids").agg(F.sum(F.when(F.col("is_add"), 1).otherwise(-1)).alias("n")).where("n <> 0")
        rows = P.expand_subsets(materialize(net.repartition(parallelism(session), "ids")), "ids", ["n"])
        deltas = materialize(rows.groupBy("pattern").agg(F.sum("n").alias("d")))
        only = state.touched(deltas.select(state.bucket_of()))
        stored = state.read(session, batch_id - 1, only)
        known = stored.join(deltas.select("pattern"), "pattern", "left_semi")
        after = materialize(advance(known, deltas, threshold))
        if work is not None:
            work(batch_id, after.count())
        was = (F.col("was_cnt") >= threshold) & (F.col("was_refs") == 0)
        now = (F.col("cnt") >= threshold) & (F.col("refs") == 0)
        changes.write(after.where(was != now).select("pattern", now.alias("is_maximal"), F.when(now, F.col("cnt")).otherwise(0).alias("cnt")), batch_id)
        rest = stored.join(deltas.select("pattern"), "pattern", "left_anti")
        state.replace(rest.unionByName(after.where("cnt <> 0 or refs <> 0").select(*ENTRY.names)), only, batch_id)

    drain_batches(baskets.select("ids", "is_add"), write, folder, "append")
    return changes.all(spark)
