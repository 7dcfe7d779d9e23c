"""Partition plans over weighted, ordered keys.

``items(grp, idx, w, size)`` has a dense 0-based ``idx`` per group; a plan cuts
a group's items into contiguous buckets: ``ranges(grp, plan_id, bucket, start,
end)`` with inclusive ends, or sizes. A plan has few buckets, an item table may
be huge and one group may hold most of it: what is known per group is written,
measured and sent to the items. The cuts of all plans of a group split its items
into pieces; items are read once for the sums of the pieces, and buckets and
overlaps of buckets are sums over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import DEFAULT_WIDTH, GroupSum, RunningSum, broadcast_if_small, ordered_scan
from ..session import materialize


def load_cap(items: DataFrame, buckets: int, ratio: float = 1.3) -> DataFrame:
    """Adds ``limit`` = sum(w) / buckets * ratio per group and ``capped`` = least(w, limit)."""
    if ratio <= 1:
        raise ValueError(f"ratio must exceed 1: {ratio}")
    totals = items.groupBy("grp").agg((F.sum("w") / buckets * ratio).alias("limit"))
    return items.join(_known(totals), "grp").withColumn("capped", F.least("w", "limit"))


def _known(df: DataFrame) -> DataFrame:
    """A frame with a few rows per group, written and measured, to be joined with items."""
    return broadcast_if_small(materialize(df))


def sizes_to_ranges(plans: DataFrame) -> DataFrame:
    """(grp, plan_id, bucket, start, end) from bucket sizes."""
    upto = Window.partitionBy("grp", "plan_id").orderBy("bucket")
    end = F.sum("size").over(upto) - 1
    return plans.select("grp", "plan_id", "bucket", (end - F.col("size") + 1).alias("start"), end.alias("end"))


def ranges_to_sizes(ranges: DataFrame) -> DataFrame:
    return ranges.select("grp", "plan_id", "bucket", (F.col("end") - F.col("start") + 1).alias("size"))


def _plan_rows(ranges: DataFrame, as_col: str) -> DataFrame:
    """One row per (grp, plan_id) with its buckets as an array."""
    bucket = F.struct("start", "end", "bucket")
    return ranges.groupBy("grp", "plan_id").agg(F.array_sort(F.collect_list(bucket)).alias(as_col))


def _bucket_of(idx: str, plan: str) -> Column:
    """Bucket of an item; null outside the plan. Empty buckets hold nothing."""
    hit = F.filter(plan, lambda b: (b["start"] <= F.col(idx)) & (F.col(idx) <= b["end"]))
    return F.get(hit, F.lit(0))["bucket"]


def assign_buckets(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items with (plan_id, bucket) for every plan of their group."""
    rows = items.join(_known(_plan_rows(ranges, "__plan")), "grp")
    return rows.withColumn("bucket", _bucket_of("idx", "__plan")).drop("__plan")


def piece_sums(items: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """(grp, lo, value): sums between neighbouring cuts of the plans; ``lo`` is a piece's first index."""
    cut = F.explode(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint") + 1))
    cuts = ranges.select("grp", cut.alias("cut")).groupBy("grp").agg(F.collect_set("cut").alias("__cuts"))
    rows = items.select("grp", "idx", value).join(_known(cuts), "grp")
    lo = F.array_max(F.filter("__cuts", lambda c: c <= F.col("idx")))
    return rows.groupBy("grp", lo.alias("lo")).agg(F.sum(value).alias(value)).where("lo is not null")


def _in_plan(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pieces with (plan_id, bucket) of each plan they lie in."""
    r = ranges.select(F.col("grp").alias("__g"), "plan_id", "bucket", "start", "end")
    return pieces.join(r, (F.col("grp") == F.col("__g")) & F.col("lo").between(F.col("start"), F.col("end"))).drop("__g", "start", "end")


def plan_overlap(items: DataFrame, ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, plan_a, plan_b, bucket_a, bucket_b, overlap) for pairs(plan_a, plan_b)."""
    placed = materialize(_in_plan(piece_sums(items, ranges, "size"), ranges))
    a = placed.select("grp", "lo", F.col("plan_id").alias("plan_a"), F.col("bucket").alias("bucket_a"), "size")
    b = placed.select("grp", "lo", F.col("plan_id").alias("plan_b"), F.col("bucket").alias("bucket_b"))
    rows = a.join(pairs.select("plan_a", "plan_b"), "plan_a").join(b, ["grp", "lo", "plan_b"])
    return rows.groupBy("grp", "plan_a", "plan_b", "bucket_a", "bucket_b").agg(F.sum("size").alias("overlap"))


def plan_validate(items: DataFrame, plans: DataFrame) -> DataFrame:
    """(grp, plan_id, violation): too few items, wrong total length, null weights or sizes."""
    have = items.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("w").alias("n_w"), F.count("size").alias("n_size")
    )
    want = plans.groupBy("grp", "plan_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("size").alias("length"))
    rows = want.join(have, "grp", "left").fillna(0, ["n_items", "n_w", "n_size"])
    checks = F.array(
        F.when(F.col("n_items") < F.col("buckets"), "fewer items than buckets"),
        F.when(F.col("n_items") != F.col("length"), "plan length differs from item count"),
        F.when(F.col("n_w") != F.col("n_size"), "weights and sizes differ in length"),
    )
    return rows.select("grp", "plan_id", F.explode(F.array_compact(checks)).alias("violation"))


def bucket_loads(items: DataFrame, ranges: DataFrame, weight: str = "w") -> DataFrame:
    rows = _in_plan(piece_sums(items, ranges, weight), ranges)
    return rows.groupBy("grp", "plan_id", "bucket").agg(F.sum(weight).alias("load"))


def plan_feasible(items: DataFrame, ranges: DataFrame, ratio: float = 1.3) -> DataFrame:
    """(grp, plan_id, feasible): every bucket's load of capped weights stays within the limit."""
    if ratio <= 1:
        raise ValueError(f"ratio must exceed 1: {ratio}")
    totals = items.groupBy("grp").agg(F.sum("w").alias("total"))
    buckets = ranges.groupBy("grp", "plan_id").agg(F.count(F.lit(1)).alias("buckets"))
    limits = buckets.join(totals, "grp").withColumn("limit", F.col("total") / F.col("buckets") * ratio)
    plans = _known(_plan_rows(ranges, "__plan").join(limits, ["grp", "plan_id"]))
    rows = items.select("grp", "idx", "w").join(plans, "grp").withColumn("bucket", _bucket_of("idx", "__plan")).where("bucket IS NOT NULL")
    loads = rows.groupBy("grp", "plan_id", "bucket", "limit").agg(F.sum(F.least("w", "limit")).alias("load"))
    return loads.groupBy("grp", "plan_id").agg(F.bool_and(F.col("load") <= F.col("limit")).alias("feasible"))


def plan_imbalance(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """(grp, plan_id, imbalance): squared distance of the bucket loads from their mean.

    Empty buckets count with load 0.
    """
    loads = ranges.select("grp", "plan_id", "bucket").join(bucket_loads(items, ranges), ["grp", "plan_id", "bucket"], "left")
    loads = loads.fillna(0.0, ["load"])
    means = loads.groupBy("grp", "plan_id").agg(F.avg("load").alias("mean"))
    gap = F.col("load") - F.col("mean")
    return loads.join(means, ["grp", "plan_id"]).groupBy("grp", "plan_id").agg(F.sum(gap * gap).alias("imbalance"))


def plan_move_cost(items: DataFrame, overlap: DataFrame, matching: DataFrame | None = None) -> DataFrame:
    """(grp, plan_a, plan_b, kept, moved) for matching(bucket_a, bucket_b), identity by default."""
    same = F.col("bucket_a") == F.col("bucket_b")
    if matching is not None:
        keys = [c for c in ("grp", "plan_a", "plan_b", "bucket_a", "bucket_b") if c in matching.columns]
        overlap = overlap.join(matching.select(*keys).withColumn("__m", F.lit(True)), keys, "left")
        same = F.coalesce("__m", F.lit(False))
    kept = overlap.groupBy("grp", "plan_a", "plan_b").agg(F.sum(F.when(same, F.col("overlap")).otherwise(0.0)).alias("kept"))
    totals = items.groupBy("grp").agg(F.sum("size").alias("total"))
    return kept.join(totals, "grp").select("grp", "plan_a", "plan_b", "kept", (F.col("total") - F.col("kept")).alias("moved"), "total")


def chain_move_cost(steps: DataFrame, costs: DataFrame) -> DataFrame:
    """(grp, steps, moved, avg_moved, share) along chain steps(grp, plan_a, plan_b).

    Equal steps are counted before the join. A step that keeps its plan moves nothing.
    """
    counted = steps.groupBy("grp", "plan_a", "plan_b").agg(F.count(F.lit(1)).alias("n"))
    priced = counted.join(costs.select("grp", "plan_a", "plan_b", "moved"), ["grp", "plan_a", "plan_b"], "left")
    moved = F.when(F.col("plan_a") == F.col("plan_b"), 0.0).otherwise(F.col("moved"))
    sums = priced.groupBy("grp").agg(F.sum("n").alias("steps"), F.sum(moved * F.col("n")).alias("moved"))
    totals = costs.groupBy("grp").agg(F.max("total").alias("total"))
    return sums.join(totals, "grp").select(
        "grp", "steps", "moved", (F.col("moved") / F.col("steps")).alias("avg_moved"), (F.col("moved") / F.col("total")).alias("share")
    )


def weighted_buckets(items: DataFrame, buckets: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``bucket`` (1-based): cuts at equal cumulative weight. A heuristic, not the optimal cut."""
    summed = ordered_scan(items, ["grp"], ["idx"], [RunningSum("cum", "w"), GroupSum("total", "w")], width)
    place = F.ceil(F.col("cum") / F.col("total") * buckets)
    return summed.withColumn("bucket", F.greatest(place, F.lit(1)).cast("bigint")).drop("cum", "total")


def plan_expected_keep(overlap: DataFrame, weights: DataFrame) -> DataFrame:
    """(grp, plan_b, expected) for source weights(plan_a, p).

    Each new bucket counts its largest overlap with every source plan, so the
    sum is an upper bound of what a one-to-one matching keeps.
    """
    largest = overlap.groupBy("grp", "plan_a", "plan_b", "bucket_b").agg(F.max("overlap").alias("best"))
    weighted = largest.join(weights, "plan_a")
    return weighted.groupBy("grp", "plan_b").agg(F.sum(F.col("best") * F.col("p")).alias("expected"))
