"""Outlier flags over an object stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import flips as X
from ..operators import outliers as O
from ..session import materialize, run_dir
from .buckets import BucketTable
from .runs import drain_batches, drain_updates
from .versions import VersionedTable

OBJECTS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("time", T.LongType()),
])
SNAPSHOT = T.StructType([
    T.StructField("projection_id", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("neighbors", T.LongType()), T.StructField("is_outlier", T.BooleanType()),
])
VALUES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("projection_id", T.IntegerType()), T.StructField("projection_value", T.DoubleType()),
])
PLACES = T.StructType([T.StructField("projection_id", T.IntegerType()), T.StructField("obj_id", T.LongType()), T.StructField("value", T.DoubleType())])
COUNTED = T.StructType([*PLACES.fields, T.StructField("neighbors", T.LongType())])
LOG = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("projection_id", T.IntegerType()), T.StructField("obj_id", T.LongType()),
    T.StructField("neighbors", T.LongType()), T.StructField("is_outlier", T.BooleanType()),
])


def snapshots(objects: DataFrame, rows: Sequence[Sequence[float]], distance: float, min_neighbors: int, folder: str | None = None) -> DataFrame:
    """Flags of all known objects after each micro-batch: snapshot columns and ``batch_id``."""
    spark = objects.sparkSession
    folder = folder or run_dir(spark, "snapshots")
    state = VersionedTable(f"{folder}/objects", OBJECTS)
    flags = VersionedTable(f"{folder}/flags", SNAPSHOT)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = state.read(batch.sparkSession, batch_id - 1).unionByName(batch.select(*OBJECTS.names))
        last = state.write(O.latest_objects(known), batch_id)
        flags.write(O.outlier_snapshot(O.project_vectors(last, rows), distance, min_neighbors), batch_id)

    drain_batches(objects, write, folder, "append")
    return flags.all(spark)


def flips(projected: DataFrame, distance: float, min_neighbors: int, folder: str | None = None, work: Callable[[int, int], None] | None = None) -> DataFrame:
    """The log of flags that flip, over a projected stream: log columns and ``batch_id``.

    The state knows where each object is, by object, and the neighbour count of each
    object, by cells of the value axis. A batch reads and rewrites the buckets of its own
    objects and of the cells around their old and new places. ``work`` is told the batch
    id and the number of known objects that the batch looked at.
    """
    spark = projected.sparkSession
    folder = folder or run_dir(spark, "flips")
    by_id = BucketTable(f"{folder}/places", PLACES, X.KEYS)
    by_cell = BucketTable(f"{folder}/counts", COUNTED, ["projection_id", X.cell(F.col("value"), distance)])
    log = VersionedTable(f"{folder}/log", LOG)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        arrivals = materialize(batch.select(*VALUES.names))
        ids = by_id.touched(arrivals.select(by_id.bucket_of("projection_id", "id")))
        places = by_id.read(session, batch_id - 1, ids)
        moved = X.moves(arrivals, places)
        spots = moved.select("projection_id", F.explode(F.array("old", "new")).alias("x")).where("x is not null")
        cells = materialize(spots.select("projection_id", F.explode(X.around(F.col("x"), distance)).alias("cell")).distinct())
        only = by_cell.touched(cells.select(by_cell.bucket_of("projection_id", "cell")))
        stored = by_cell.read(session, batch_id - 1, only)
        own = [stored["projection_id"] == cells["projection_id"], X.cell(stored["value"], distance) == cells["cell"]]
        known = materialize(stored.join(cells, own, "left_semi"))
        if work is not None:
            work(batch_id, known.count())
        found, after = X.advance(known, moved, distance, min_neighbors)
        log.write(found, batch_id)
        rest = stored.join(cells, own, "left_anti")
        by_cell.replace(rest.unionByName(after), only, batch_id)
        last = moved.groupBy(*X.KEYS).agg(F.max_by("new", "seq").alias("value"))
        by_id.replace(places.join(last, X.KEYS, "left_anti").unionByName(last), ids, batch_id)

    drain_batches(projected, write, folder, "append")
    return log.all(spark)


def merge_flags(flags: DataFrame, projections: int, event_time: str, delay: str, folder: str | None = None) -> DataFrame:
    """OR over the projections of an arrival; an arrival that never completes is dropped after ``delay``."""
    timed = flags.withWatermark(event_time, delay)
    keys = [event_time, "seq", "id", "obj_id"]
    return drain_updates(O.outlier_merge(timed, projections, keys), keys, "merge-flags", folder)
