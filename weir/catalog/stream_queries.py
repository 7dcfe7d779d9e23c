"""The streaming forms over the given tables; results equal the batch forms."""

from pyspark.sql import functions as F

from ..functions.arrays import joined
from ..operators import flips as X
from ..operators import outliers as O
from ..operators import telemetry as M
from ..session import run_dir
from ..streaming import outliers as SO
from ..streaming import patterns as SP
from ..streaming import telemetry as SM
from ..sources import metric_lines as L
from ..sources.queue import Queue
from ..streaming.carry import carry_forward
from ..streaming.fanout import fan_out, parquet_writer
from ..streaming.pending import correlate_with_tries, merge_on_last
from ..streaming.runs import drain_all_to_parquet, drain_to_parquet, parquet_stream
from . import inputs as I
from .pattern_queries import DISTANCE, MIN_NEIGHBORS, PROJECTIONS, moving, projected
from .registry import ORACLES, query
from .sql import with_
from .telemetry_queries import counters, r4


def basket_queue(spark, sf, folder, is_add):
    """Append the additions or removals of all baskets to a file queue."""
    I.basket_ids(spark, sf).where(F.col("is_add") == is_add).write.mode("append").parquet(folder)


@query("pattern_count_stream", ORACLES["pattern_count"])
def pattern_count_stream(spark, sf):
    folder = run_dir(spark, "baskets")
    I.basket_ids(spark, sf).write.parquet(folder)
    counts = SP.pattern_counts(parquet_stream(spark, folder, "*.parquet"))
    return counts.select(joined("pattern").alias("pattern"), "cnt")


@query("pattern_changelog_stream", ORACLES["pattern_changelog"])
def pattern_changelog_stream(spark, sf):
    """All additions in one run, the removals in a second run that continues it."""
    queue, folder = run_dir(spark, "baskets"), run_dir(spark, "changelog")
    t = I.pattern_threshold(spark, sf)
    basket_queue(spark, sf, queue, True)
    first = SP.maximal_changelog(parquet_stream(spark, queue, "*.parquet"), t, folder).agg(F.max("batch_id")).first()[0]
    done = -1 if first is None else first
    basket_queue(spark, sf, queue, False)
    log = SP.maximal_changelog(parquet_stream(spark, queue, "*.parquet"), t, folder)
    return log.where(F.col("batch_id") > done).select(joined("pattern").alias("pattern"), "is_maximal", "cnt")


def object_stream(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    id_ = F.col("vec_id")
    return parquet_stream(spark, sf, "embeddings.parquet").select(id_.alias("seq"), id_.alias("id"), v.alias("vector"), id_.alias("time"))


@query("outlier_snapshot_stream", ORACLES["outlier_snapshot"])
def outlier_snapshot_stream(spark, sf):
    rows = O.walsh_rows(PROJECTIONS, 64)
    return SO.snapshots(object_stream(spark, sf), rows, DISTANCE, MIN_NEIGHBORS).drop("batch_id")


@query("outlier_per_arrival_stream", ORACLES["outlier_per_arrival"])
def outlier_per_arrival_stream(spark, sf):
    objects = moving(object_stream(spark, sf), I.objects(spark, sf).count())
    projected = O.project_vectors(objects, O.walsh_rows(PROJECTIONS, 64), ["seq", "id"])
    return X.since_complete(SO.flips(projected, 0.05, MIN_NEIGHBORS).drop("batch_id"))


@query("cmv_window_stream", ORACLES["cmv_window"])
def cmv_window_stream(spark, sf):
    stream = I.sample_columns(parquet_stream(spark, sf, "events.parquet")).withColumn("ts", SM.event_time(F.col("time")))
    keys = ["component", "task", "stream"]
    w = SM.drain_cmv_windows(stream, "1 day", "2 days", keys)
    return w.select("window_start", *keys, "cnt", *r4("total", "total_2"))


@query("latest_metric_stream", ORACLES["latest_metric"])
def latest_metric_stream(spark, sf):
    """The points as a queue of eight files, one batch each."""
    queue, folder = run_dir(spark, "points"), run_dir(spark, "latest")
    L.select_metrics(I.metric_points(spark, sf), list(L.RENAMES)).repartition(8).write.parquet(queue)
    store = SM.latest_counters(parquet_stream(spark, queue, "*.parquet", 1), ["component", "task", "name"], "cycle", folder)
    return counters(store.read(spark, SM.last_batch(spark, folder)))


@query("outlier_merge_stream", ORACLES["outlier_merge"])
def outlier_merge_stream(spark, sf):
    """Each object goes out with the last of its projections; the queue is not in any order."""
    queue = run_dir(spark, "flags")
    flags = O.outlier_snapshot(projected(spark, sf), DISTANCE, MIN_NEIGHBORS)
    timed = flags.select("time", "id", "projection_id", "is_outlier", F.timestamp_millis(F.col("time") + I.DAY_MS).alias("ts"))
    timed.repartition(4, "projection_id").write.parquet(queue)
    merged = merge_on_last(parquet_stream(spark, queue, "*.parquet", 1), PROJECTIONS, "ts", "1 day", ["time", "id"], "1 day")
    return drain_to_parquet(merged, "merge").select("id", "is_outlier")


@query("trace_correlate_stream", ORACLES["trace_correlate"])
def trace_correlate_stream(spark, sf):
    """Completions and executions as two queues; a last row of each, long after, lets the last tries run out."""
    done, ran, folder = run_dir(spark, "done"), run_dir(spark, "ran"), run_dir(spark, "tries")
    at = lambda ms: F.timestamp_millis(F.col(ms))
    c = I.completions(spark, sf).select("trace", (F.col("end") - F.col("start")).alias("latency"), at("end").alias("done_at"))
    e = I.some_executions(spark, sf).select("trace", "component", "arrival", "departure", at("departure").alias("ran_at"))
    c.write.parquet(done)
    e.write.parquet(ran)

    def run():
        joined = correlate_with_tries(parquet_stream(spark, done, "*.parquet"), parquet_stream(spark, ran, "*.parquet"), delay="36500 days")
        return drain_to_parquet(joined, "tries", folder)

    run()
    far = F.lit("2200-01-01").cast("timestamp")
    spark.range(1).select(F.lit(-1).cast("bigint").alias("trace"), F.lit(0).cast("bigint").alias("latency"), far.alias("done_at")).write.mode("append").parquet(done)
    return run().where("trace >= 0").drop("tries")


@query("consumer_fanout", with_("""SELECT 'all' AS sink, component, task, count(*) AS n, round(sum(ms), 2) AS total FROM samples GROUP BY ALL
  UNION ALL SELECT 'slow', component, task, count(*), round(sum(ms), 2) FROM samples WHERE ms > 100 GROUP BY ALL""", "samples"))
def consumer_fanout(spark, sf):
    """The samples as a stream with two consumers: one keeps sums per task and batch, the other the slow samples."""
    folder = run_dir(spark, "fanout")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total")]
    writers = {
        "all": parquet_writer(f"{folder}/all", lambda rows: rows.groupBy("component", "task").agg(*sums)),
        "slow": parquet_writer(f"{folder}/slow", lambda rows: rows.where("ms > 100").select("component", "task", F.lit(1).cast("bigint").alias("n"), F.col("ms").alias("total"))),
    }
    fan_out(I.sample_columns(parquet_stream(spark, sf, "events.parquet")), writers, f"{folder}/run")
    both = [spark.read.schema("component string, task int, n long, total double").parquet(f"{folder}/{s}").withColumn("sink", F.lit(s)) for s in writers]
    return both[0].unionByName(both[1]).groupBy("sink", "component", "task").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("snapshot_ffill_stream", ORACLES["snapshot_ffill"])
def snapshot_ffill_stream(spark, sf):
    """Daily reports in three runs, each of which continues the one before; a last row closes the last day."""
    queue, folder = run_dir(spark, "reports"), run_dir(spark, "carry")
    reports = I.parsed_window(spark, sf).withColumnRenamed("time", "cycle")
    first, last = reports.agg(F.min("cycle"), F.max("cycle")).first()
    days = (last - first) // I.DAY_MS + 1
    cuts = [first + days * k // 3 * I.DAY_MS for k in range(3)] + [last + I.DAY_MS]
    for low, high in zip(cuts, cuts[1:]):
        part = reports.where((F.col("cycle") >= low) & (F.col("cycle") < high))
        if high > last:
            close = reports.limit(1).withColumn("cycle", F.lit(high).cast("bigint"))
            part = part.unionByName(close)
        part.write.mode("append").parquet(queue)
        carried = drain_to_parquet(carry_forward(parquet_stream(spark, queue, "*.parquet"), ["component", "task", "type"], width=I.DAY_MS), "carry", folder)
    # The batch form knows only days on which some task reports.
    carried = carried.join(reports.select("cycle").distinct(), "cycle", "left_semi")
    rows = M.component_rollup(M.measurements(carried, ["component", "task", "type", "cycle", "reported_cycle"]), ["cycle"])
    return rows.select("component", "type", "cycle", "metric", "stream", "cnt", *r4("total", "total_2"), "empty")


QUEUE = """(SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS "offset" FROM orders)"""


def order_queue(spark, sf):
    """The orders as a queue: one append of the even keys, then one of the odd keys."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    queue = Queue(spark, run_dir(spark, "queue"), orders.schema, size=4096)
    for odd in (0, 1):
        queue.append(orders.where(F.col("o_orderkey") % 2 == odd), ["o_orderkey"])
    return queue


@query("queue_stream", f'SELECT "offset", o_orderkey, o_totalprice FROM {QUEUE}')
def queue_stream(spark, sf):
    """All rows of the queue as a stream, two segments a batch; ten consumers share the segments."""
    return drain_all_to_parquet(order_queue(spark, sf).streams(8192, 10), "queue-run")


@query("queue_range", f'SELECT "offset", o_orderkey, o_totalprice FROM {QUEUE} WHERE "offset" >= 6000 AND "offset" < 11000')
def queue_range(spark, sf):
    """A range of 5,000 rows, which opens its segments only."""
    return order_queue(spark, sf).scan(6000, 5000)
