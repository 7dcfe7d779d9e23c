"""Ordered computations that do not put a whole group into one task.

A plain ``Window.partitionBy(key)`` sends every row of a hot key to one task.
Here each group is first cut into ordered blocks. Row numbers, running sums and
lags are computed inside the blocks, one small summary row per block carries
the state over block borders, and a join on (group, block) adds it back.

Blocks come from one of two places:

* ``width``: ``floor(order / width)`` on an integer order column. If the order
  column is unique within a group, a block has at most ``width`` rows.
* ``range_blocks``: Spark's range partitioner, for any order columns. The
  partitioned rows are checkpointed, because a second evaluation could sample
  other borders.

``ordered_scan`` reads its input twice, once for the rows and once for the
block summaries. That is two column-pruned file scans for a table; callers with
an expensive input ``materialize`` it first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import materialize

DEFAULT_WIDTH = 1_000_000
# Blocks of ids whose summaries may pass one window.
MOST_BLOCKS = 1 << 16
BLOCK = "__block"


@dataclass(frozen=True)
class RowNumber:
    """1-based position within the group."""

    out: str


@dataclass(frozen=True)
class RunningSum:
    """Sum of ``value`` up to and including the row."""

    out: str
    value: str


@dataclass(frozen=True)
class Lag:
    """``value`` of the previous row, null on the first row of the group."""

    out: str
    value: str


@dataclass(frozen=True)
class LastValue:
    """Last non-null ``value`` up to and including the row."""

    out: str
    value: str


@dataclass(frozen=True)
class GroupCount:
    """Rows of the whole group."""

    out: str


@dataclass(frozen=True)
class GroupSum:
    """Sum of ``value`` over the whole group."""

    out: str
    value: str


Spec = RowNumber | RunningSum | Lag | LastValue | GroupCount | GroupSum


def parallelism(spark: SparkSession) -> int:
    """Partitions for work that is heavier than its input bytes suggest."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle a file scan that has fewer splits than the cluster has cores.

    A file with one large row group is one task otherwise. Sources with enough
    splits pass through unchanged. Meant for plain scans: counting the splits
    of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint when the measured size allows it, else the frame as it is.

    Costs one aggregate over ``df``; for lookup tables whose size the planner
    cannot know. Beyond the bound Spark joins by shuffle.
    """
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(16))
    size = df.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def int_block(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Spec],
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Scan each group in order; ``order[0]`` is an integer column, the rest break ties."""
    return _scan(df.withColumn(BLOCK, int_block(order[0], width)), group, order, specs)


def range_scan(
    df: DataFrame, group: Sequence[str], order: Sequence[str], specs: Sequence[Spec]
) -> DataFrame:
    """Scan each group in the order of any sortable columns."""
    return _scan(range_blocks(df, [*group, *order]), group, order, specs)


def range_blocks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = df.repartitionByRange(parts, *cols).withColumn(BLOCK, F.spark_partition_id())
    return materialize(blocked)


def numbered_scan(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """As ``ordered_scan`` with a ``RowNumber``, for results as large as the input.

    The rows in earlier blocks come as a first row of each block, so that the rows themselves move and are
    sorted once; joined to the summaries of large tables they would move again.
    """
    df = df.withColumn(BLOCK, int_block(order[0], width))
    keys = [*group, BLOCK]
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    carries = sums.select(*keys, F.sum("__n").over(before).alias("__n")).where("__n is not null")
    rest = [c for c in df.columns if c not in keys]
    kinds = {f.name: f.dataType for f in df.schema}
    first = carries.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], "__n", F.lit(False).alias("__row"))
    rows = df.select(*keys, *rest, F.lit(1).cast("bigint").alias("__n"), F.lit(True).alias("__row")).union(first)
    inside = Window.partitionBy(*keys).orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn(out, F.sum("__n").over(inside)).where("__row")
    return numbered.select(*[F.col(c) for c in df.columns if c != BLOCK], out)


def _scan(df: DataFrame, group: Sequence[str], order: Sequence[str], specs: Sequence[Spec]) -> DataFrame:
    inside = Window.partitionBy(*group, BLOCK).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per (group, block): a window over these rows is short.
    borders = Window.partitionBy(*group).orderBy(BLOCK) if group else Window.orderBy(BLOCK)
    before = borders.rowsBetween(Window.unboundedPreceding, -1)
    whole = borders.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    local, summary, carry, final = {}, {}, {}, {}
    rank = "__rank"
    local[rank] = F.row_number().over(inside)
    for i, spec in enumerate(specs):
        l, s, c = f"__local{i}", f"__sum{i}", f"__carry{i}"
        if isinstance(spec, RowNumber):
            summary[s] = F.count(F.lit(1))
            carry[c] = F.sum(s).over(before)
            final[spec.out] = (F.col(rank) + F.coalesce(c, F.lit(0))).cast("bigint")
        elif isinstance(spec, RunningSum):
            local[l] = F.sum(spec.value).over(running)
            summary[s] = F.sum(spec.value)
            carry[c] = F.sum(s).over(before)
            final[spec.out] = F.col(l) + F.coalesce(F.col(c), F.lit(0))
        elif isinstance(spec, Lag):
            local[l] = F.lag(spec.value).over(inside)
            # The struct keeps a null value apart from "no row".
            summary[s] = F.max_by(F.struct(F.col(spec.value).alias("v")), F.struct(*order))
            carry[c] = F.lag(s).over(borders)
            final[spec.out] = F.when(F.col(rank) == 1, F.col(c)["v"]).otherwise(F.col(l))
        elif isinstance(spec, LastValue):
            local[l] = F.last(spec.value, ignorenulls=True).over(running)
            known = F.when(F.col(spec.value).isNotNull(), F.struct(*order))
            summary[s] = F.max_by(spec.value, known)
            carry[c] = F.last(s, ignorenulls=True).over(before)
            final[spec.out] = F.coalesce(F.col(l), F.col(c))
        elif isinstance(spec, GroupCount):
            summary[s] = F.count(F.lit(1))
            carry[c] = F.sum(s).over(whole)
            final[spec.out] = F.col(c)
        elif isinstance(spec, GroupSum):
            summary[s] = F.sum(spec.value)
            carry[c] = F.sum(s).over(whole)
            final[spec.out] = F.col(c)

    keys = [*group, BLOCK]
    sums = df.groupBy(*keys).agg(*[e.alias(n) for n, e in summary.items()])
    carries = sums.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[e.alias(n) for n, e in carry.items()],
    )
    scanned = df.select("*", *[e.alias(n) for n, e in local.items()])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    keep = [F.col(c) for c in df.columns if c != BLOCK]
    return scanned.join(carries, cond).select(*keep, *[e.alias(n) for n, e in final.items()])


def dense_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0-based dense position in the order of ``order`` (unique)."""
    numbered = range_scan(df, [], order, [RowNumber(out)])
    return numbered.withColumn(out, F.col(out) - 1)


def dense_int_index(df: DataFrame, seq: str, out: str, width: int = DEFAULT_WIDTH, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """0-based dense position by a unique integer column.

    Needs no checkpoint while the ids, measured first, have few blocks. Many sparse ids (hashes, times)
    would be blocks of their own, so they are cut by rank: one block per shuffle partition.
    """
    low, high, rows = df.agg(F.min(seq), F.max(seq), F.count(seq)).first()
    if rows and min(high // width - low // width + 1, rows) > most_blocks:
        return dense_index(df, [seq], out)
    numbered = ordered_scan(df, [], [seq], [RowNumber(out)], width)
    return numbered.withColumn(out, F.col(out) - 1)
