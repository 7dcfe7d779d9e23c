"""Drain-all runs: file streams in, replay-safe sinks out."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import run_dir


def parquet_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a table: ``folder/name`` itself if it is a folder, else the files of ``folder`` that match ``name``."""
    path = f"{folder}/{name}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if "*" not in name and _status(spark, path, "isDirectory"):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def _status(spark: SparkSession, path: str, question: str) -> bool:
    """``exists`` or ``isDirectory`` in whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(place.getFileSystem(spark._jsc.hadoopConfiguration()), question)(place)


def drain_to_parquet(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Append-mode run until the source is empty; returns the written rows.

    A given ``folder`` keeps offsets and state between runs, so a second run
    continues where the first one stopped.
    """
    folder = folder or run_dir(stream.sparkSession, label)
    _append(stream, folder).awaitTermination()
    return _appended(stream, folder)


def drain_all_to_parquet(streams: Sequence[DataFrame], label: str, folder: str | None = None) -> DataFrame:
    """Append-mode runs of several streams side by side until all sources are empty; returns the rows of all.

    A micro-batch costs the driver some time however few rows it has, so consumers that
    share a source get through more batches together. Each has its own offsets and rows
    below ``folder``; if one fails the others are stopped, and a second run continues all.
    """
    folder = folder or run_dir(streams[0].sparkSession, label)
    folders = [f"{folder}/{k}" for k in range(len(streams))]
    running = []
    try:
        for stream, place in zip(streams, folders):
            running.append(_append(stream, place))
        for query in running:
            query.awaitTermination()
    finally:
        for query in running:
            query.stop()
    return functools.reduce(DataFrame.unionByName, map(_appended, streams, folders))


def _append(stream: DataFrame, folder: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    )


def _appended(stream: DataFrame, folder: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "update") -> None:
    """Run until the source is empty, handing every micro-batch to ``write``."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_updates(stream: DataFrame, keys: Sequence[str], label: str, folder: str | None = None) -> DataFrame:
    """Update-mode run; returns the last row of every key.

    Each micro-batch overwrites its own ``batch_id`` folder, so a repeated
    batch leaves the same files.
    """
    spark = stream.sparkSession
    folder = folder or run_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    drain_batches(stream, write, folder)
    if not _status(spark, f"{folder}/rows", "exists"):  # the source was empty
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("__v"))
    return last.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in values])
