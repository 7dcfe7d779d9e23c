"""Distance-based outliers on projections of a vector stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..scale import Lag, LastValue, RunningSum, ordered_scan, range_scan
from ..session import materialize


def walsh_rows(count: int, dim: int) -> list[list[float]]:
    """Orthogonal unit-length projection vectors for a power-of-two dimension."""
    scale = dim ** -0.5
    return [[scale * (1 - 2 * ((i & j).bit_count() % 2)) for j in range(dim)] for i in range(count)]


def project_vectors(objects: DataFrame, rows: Sequence[Sequence[float]], keep: Sequence[str] = ("seq", "id", "time")) -> DataFrame:
    """(keep..., projection_id, projection_value): one row per object and projection vector.

    The projection vectors are parameters, so they travel inside the plan and
    no join is needed.
    """
    values = A.inner_products(F.col("vector"), rows)
    return objects.select(*keep, F.posexplode(values).alias("projection_id", "projection_value"))


def latest_objects(objects: DataFrame) -> DataFrame:
    """Last vector and time of each object by arrival number."""
    last = objects.groupBy("id").agg(F.max_by(F.struct("seq", "vector", "time"), "seq").alias("o"))
    return last.select("o.seq", "id", "o.vector", "o.time")


def neighbor_counts(projected: DataFrame, distance: float) -> DataFrame:
    """Input rows plus ``neighbors``: others of the same projection within ``distance``.

    No pairs are formed. Equal values are folded first; each distinct value v
    then asks how many values lie below v - distance and up to v + distance,
    and both answers come from one running sum over all values and questions.
    """
    keys = ["projection_id", "projection_value"]
    folded = projected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    v = F.col("projection_value")
    # kind 0: question below, asked before equal values; 1: the values; 2: question above.
    marks = F.array(
        F.struct((v - distance).alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("weight")),
        F.struct(v.alias("x"), F.lit(1).alias("kind"), F.col("n").alias("weight")),
        F.struct((v + distance).alias("x"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("weight")),
    )
    events = folded.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*")
    ranked = range_scan(events, ["projection_id"], ["x", "kind"], [RunningSum("below", "weight")])
    signed = F.when(F.col("kind") == 2, F.col("below")).when(F.col("kind") == 0, -F.col("below")).otherwise(0)
    counts = ranked.groupBy(*keys).agg((F.sum(signed) - 1).alias("neighbors"))
    return projected.join(counts, keys)


def outlier_snapshot(projected: DataFrame, distance: float, min_neighbors: int) -> DataFrame:
    counted = neighbor_counts(projected, distance)
    return counted.withColumn("is_outlier", F.col("neighbors") < min_neighbors)


def outlier_merge(flags: DataFrame, projections: int, keys: Sequence[str] = ("seq", "id", "obj_id")) -> DataFrame:
    """OR of the flags of an object once all projections reported."""
    merged = flags.groupBy(*keys).agg(F.bool_or("is_outlier").alias("is_outlier"), F.count(F.lit(1)).alias("reports"))
    return merged.where(F.col("reports") == projections).drop("reports")


def outliers_per_arrival(projected: DataFrame, object_count: int, distance: float, min_neighbors: int, width: int = 4096) -> DataFrame:
    """Flags of all objects at every arrival: (seq, id, projection_id, obj_id, neighbors, is_outlier).

    ``seq`` is a unique arrival number, ``id`` in 0..object_count-1. Rows appear
    once every object, the arriving one included, has been seen before. The result has one row per arrival, object
    and projection by definition; the same grid carries the computation: the
    object that arrives gets a fresh count, every other object a step of +1, 0
    or -1, and the running sum since an object's own arrival is its count.
    """
    values = materialize(projected.select("seq", "id", "projection_id", F.col("projection_value").alias("new")))
    arrivals = materialize(ordered_scan(values, ["projection_id", "id"], ["seq"], [Lag("old", "new")], width))
    grid = arrivals.withColumn("obj_id", F.explode(F.sequence(F.lit(0), F.lit(object_count - 1))))
    own = F.col("obj_id") == F.col("id")
    grid = grid.withColumn("own_value", F.when(own, F.col("new"))).withColumn("own_seq", F.when(own, F.col("seq")))
    seen = ordered_scan(
        grid, ["projection_id", "obj_id"], ["seq"],
        [LastValue("value", "own_value"), LastValue("since", "own_seq")], width,
    )
    near_new = F.coalesce(F.abs(F.col("new") - F.col("value")) <= distance, F.lit(False)).cast("int")
    near_old = F.coalesce(F.abs(F.col("old") - F.col("value")) <= distance, F.lit(False)).cast("int")
    seen = materialize(seen.withColumn("near", near_new))
    # What the arriving object itself sees: one row per (projection, arrival).
    fresh = seen.groupBy("projection_id", "seq").agg(
        F.sum(F.when(~own, F.col("near")).otherwise(0)).alias("fresh"),
        F.count("value").alias("known"),
    )
    steps = seen.join(fresh, ["projection_id", "seq"])
    steps = steps.withColumn("step", F.when(own, F.col("fresh")).otherwise(F.col("near") - near_old))
    counted = ordered_scan(
        steps.where("since IS NOT NULL"), ["projection_id", "obj_id", "since"], ["seq"],
        [RunningSum("neighbors", "step")], width,
    )
    full = counted.where((F.col("known") == object_count) & F.col("old").isNotNull())
    return full.select(
        "seq", "id", "projection_id", "obj_id", F.col("neighbors").cast("bigint").alias("neighbors"),
        (F.col("neighbors") < min_neighbors).alias("is_outlier"),
    )
