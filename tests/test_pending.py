"""Keyed waiting: rows come when they are complete, not with the watermark; tries, expiry, restart."""

import random

from pyspark.sql import functions as F

from weir.streaming.pending import correlate_with_tries, merge_on_last
from weir.streaming.runs import drain_to_parquet

from .test_streaming import T0, put, rows, stream


def flags(spark, data):
    df = spark.createDataFrame(data, "seq bigint, id bigint, obj_id bigint, projection_id int, is_outlier boolean, at bigint")
    return df.withColumn("ts", F.timestamp_millis(F.col("at") * 1000 + T0)).drop("at")


def state_rows(spark, folder):
    """Keys that the state holds after the last batch."""
    return spark.read.format("statestore").option("path", f"{folder}/offsets").load().count()


def test_merge_comes_with_the_last_report(spark, tmp_path):
    queue, folder = tmp_path / "q", str(tmp_path / "s")

    def run():
        merged = merge_on_last(stream(spark, queue, 1), 3, "ts", "10 minutes")
        return rows(drain_to_parquet(merged, "merge", folder))

    put(flags(spark, [(1, 1, 7, 0, False, 0), (1, 1, 7, 1, False, 0), (2, 1, 7, 0, True, 1), (2, 1, 7, 0, True, 1), (2, 1, 7, 1, False, 1)]), queue)
    assert run() == []
    # Completes one object while the watermark is far behind its time; the other one lacks a projection.
    put(flags(spark, [(1, 1, 7, 2, True, 2)]), queue)
    assert run() == [(1, 1, 7, True)]
    put(flags(spark, [(3, 3, 3, p, False, 3) for p in range(3)]), queue)
    assert run() == [(1, 1, 7, True), (3, 3, 3, False)]
    # An hour later the incomplete one is forgotten; its last report then waits alone.
    put(flags(spark, [(9, 9, 9, p, False, 3600) for p in range(3)]), queue)
    run()
    assert state_rows(spark, folder) == 0
    put(flags(spark, [(2, 1, 7, 2, False, 3600)]), queue)
    assert run() == [(1, 1, 7, True), (3, 3, 3, False), (9, 9, 9, False)]


def test_three_tries(spark, tmp_path):
    """Early, at each look, never; an execution without completion; across restarts."""
    c, e, folder = tmp_path / "c", tmp_path / "e", str(tmp_path / "s")

    def completed(*data):
        df = spark.createDataFrame(list(data), "trace bigint, latency bigint, at bigint")
        put(df.withColumn("done_at", F.timestamp_millis(F.col("at") * 1000 + T0)).drop("at"), c)

    def executed(*data):
        df = spark.createDataFrame(list(data), "trace bigint, component string, at bigint")
        put(df.select("trace", "component", F.lit(5).alias("arrival"), F.lit(6).alias("departure"), F.timestamp_millis(F.col("at") * 1000 + T0).alias("ran_at")), e)

    def run():
        joined = correlate_with_tries(stream(spark, c), stream(spark, e))
        out = drain_to_parquet(joined, "tries", folder)
        return {(r.trace, r.tries, r.component) for r in out.collect()}

    executed((1, "a", 0), (1, "b", 0), (50, "orphan", 0))
    completed((1, 10, 1), (2, 20, 1), (3, 30, 1), (4, 40, 1))
    assert run() == {(1, 0, "a"), (1, 0, "b")}
    # Trace 2 runs before the first look, trace 3 before the second.
    executed((2, "late", 30))
    assert (2, 1, "late") not in run()
    executed((90, "tick", 70))
    assert run() == {(1, 0, "a"), (1, 0, "b"), (2, 1, "late")}
    executed((3, "later", 100), (91, "tick", 130))
    assert run() >= {(3, 2, "later")}
    executed((92, "tick", 200))
    assert run() == {(1, 0, "a"), (1, 0, "b"), (2, 1, "late"), (3, 2, "later"), (4, 3, None)}
    executed((93, "tick", 100_000))
    executed((94, "tick", 200_000))
    run()
    assert state_rows(spark, folder) == 1  # the last tick


def test_traces_of_a_bucket_share_calls_and_state(spark, tmp_path):
    """One bucket and a bucket per trace give the same rows; nulls and large numbers come through."""
    rnd, c, e, folders, now = random.Random(4), tmp_path / "c", tmp_path / "e", {n: str(tmp_path / f"s{n}") for n in (1, 1 << 20)}, 0
    timed = lambda data, kind, name: spark.createDataFrame(data, kind).withColumn(name, F.timestamp_millis(F.col("at") * 1000 + T0)).drop("at")

    def run(n):
        joined = correlate_with_tries(stream(spark, c), stream(spark, e), buckets=n)
        return rows(drain_to_parquet(joined, "tries", folders[n]))

    big = 2**53 + 1
    for batch in range(3):
        # A null trace and the trace 0 are two.
        done = [(t, rnd.choice([None, big, 8]), now + rnd.randrange(50)) for t in rnd.sample([None, *range(25)], 8)]
        ran = [(rnd.choice([None, *range(25)]), rnd.choice(["a", "b", None]), rnd.choice([None, big]), rnd.choice([None, 6]), now + rnd.randrange(50)) for _ in range(12)]
        put(timed(done, "trace bigint, latency bigint, at bigint", "done_at"), c)
        put(timed(ran, "trace bigint, component string, arrival bigint, departure bigint, at bigint", "ran_at"), e)
        got = {n: run(n) for n in folders}
        assert got[1] == got[1 << 20]
        assert state_rows(spark, folders[1]) <= 2 < state_rows(spark, folders[1 << 20])
        now += 200 if batch else 70
    assert {r[2] for r in got[1]} >= {0, 3} and any(r[4] == big for r in got[1])
    put(timed([(500, "tick", 1, 1, 200_000)], "trace bigint, component string, arrival bigint, departure bigint, at bigint", "ran_at"), e)
    assert run(1) == run(1 << 20)


def test_one_call_takes_many_traces(spark, tmp_path):
    """Three thousand traces in eight state rows, of which the executions without completion are left."""
    c, e, folder = tmp_path / "c", tmp_path / "e", str(tmp_path / "s")
    ids = spark.range(3000).withColumnRenamed("id", "trace")
    at = F.timestamp_millis(F.lit(T0))
    put(ids.where("trace % 3 > 0").select("trace", F.lit(9).alias("latency"), at.alias("done_at")), c)
    put(ids.where("trace % 3 < 2").select("trace", F.lit("a").alias("component"), F.lit(1).alias("arrival"), F.lit(2).alias("departure"), at.alias("ran_at")), e)
    out = drain_to_parquet(correlate_with_tries(stream(spark, c), stream(spark, e), buckets=8), "tries", folder)
    assert rows(out) == rows(ids.where("trace % 3 = 1").selectExpr("trace", "9", "0", "'a'", "1", "2"))
    assert state_rows(spark, folder) == 8
