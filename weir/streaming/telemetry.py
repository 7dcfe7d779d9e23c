"""Telemetry streams: report windows, trace correlation, latest values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cmv
from ..operators import telemetry as M
from ..session import materialize, run_dir
from .buckets import BucketTable
from .runs import drain_batches, drain_to_parquet, drain_updates

# Fixed value: three tries of 60 seconds each.
TRACE_WAIT = "180 seconds"


def cmv_windows(samples: DataFrame, width: str, delay: str, keys: Sequence[str], value: str = "ms", event_time: str = "ts") -> DataFrame:
    """Streaming count, sum and sum of squares per tumbling window and key."""
    timed = samples.withWatermark(event_time, delay)
    agg = timed.groupBy(F.window(event_time, width).alias("w"), *keys).agg(*cmv.accumulate(value))
    return agg.select(F.unix_millis("w.start").alias("window_start"), *keys, "cnt", "total", "total_2")


def drain_cmv_windows(samples: DataFrame, width: str, delay: str, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Windows after all input, the open ones included."""
    return drain_updates(cmv_windows(samples, width, delay, keys), ["window_start", *keys], "cmv", folder)


def correlate_traces(completions: DataFrame, executions: DataFrame, wait: str = TRACE_WAIT, keep_unmatched: bool = True) -> DataFrame:
    """Completions(trace, latency, done_at) with executions(trace, ..., ran_at) of the trace.

    Both sides wait ``wait`` for each other. A completion without executions is
    emitted with nulls once the watermark has passed it.
    """
    c = completions.withWatermark("done_at", wait).withColumnRenamed("trace", "c_trace")
    e = executions.withWatermark("ran_at", wait)
    span = F.expr(f"INTERVAL {wait}")
    near = (F.col("ran_at") >= F.col("done_at") - span) & (F.col("ran_at") <= F.col("done_at") + span)
    joined = c.join(e, (F.col("c_trace") == F.col("trace")) & near, "left_outer" if keep_unmatched else "inner")
    return joined.drop("trace").withColumnRenamed("c_trace", "trace")


def pair_latency(starts: DataFrame, outcomes: DataFrame, limit: str = "1 hour", delay: str = TRACE_WAIT) -> DataFrame:
    """starts(trace, start, started_at), outcomes(trace, end, failed, ended_at) -> (trace, latency).

    ``limit`` is the longest time from start to outcome; it bounds the state.
    """
    s = starts.withWatermark("started_at", delay).withColumnRenamed("trace", "s_trace")
    o = outcomes.withWatermark("ended_at", delay)
    in_time = (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {limit}"))
    joined = o.join(s, (F.col("trace") == F.col("s_trace")) & in_time)
    latency = F.when(F.col("failed"), F.lit(-1)).otherwise(F.col("end") - F.col("start"))
    return joined.select("trace", latency.cast("bigint").alias("latency"))


def latest_counters(points: DataFrame, keys: Sequence[str], order: str, folder: str | None = None, keep: int = 2) -> BucketTable:
    """Store of the last value of every counter: map values merge key by key over the stored ones.

    A micro-batch is reduced to its own last values first; then only the buckets of its
    keys are read, merged and rewritten. The store can be read as of any of the last
    ``keep`` batches.
    """
    spark = points.sparkSession
    folder = folder or run_dir(spark, "latest")
    types = {f.name: f.dataType for f in points.schema}
    schema = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("counter", T.StringType()), T.StructField("value", T.StringType()), T.StructField(order, types[order])])
    store = BucketTable(f"{folder}/store", schema, list(keys), keep=keep)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = materialize(M.latest_counters(batch, keys, order))
        only = store.touched(new.select(store.bucket_of()))
        old = store.read(batch.sparkSession, batch_id - 1, only)
        store.replace(M.newest(old.unionByName(new), [*keys, "counter"], order), only, batch_id)

    drain_batches(points, write, folder, "append")
    return store


def last_batch(spark: SparkSession, folder: str) -> int:
    """The number of the last batch that a run in this folder committed, -1 if none."""
    done = [f for f in spark.sparkContext.wholeTextFiles(f"{folder}/offsets/commits/[0-9]*").keys().collect()]
    return max((int(f.rsplit("/", 1)[1]) for f in done), default=-1)


def drain(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    return drain_to_parquet(stream, label, folder)


def event_time(time_ms: Column) -> Column:
    """Timestamp for watermarks from epoch milliseconds."""
    return F.timestamp_millis(time_ms)
