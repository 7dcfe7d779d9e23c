"""Streams drained with availableNow equal the batch results, also after a restart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weir.operators import outliers as O
from weir.operators import patterns as P
from weir.operators import telemetry as M
from weir.operators import text as X
from weir.sources import records as R
from weir.streaming import outliers as SO
from weir.streaming import patterns as SP
from weir.streaming import telemetry as SM
from weir.streaming import text as ST
from weir.streaming.runs import drain_to_parquet, drain_updates, parquet_stream

from .test_text import SENTENCES

# Watermarks start at the epoch, so event times lie after it.
T0 = 1_700_000_000_000


def put(df, folder):
    """Add one file to a queue folder."""
    df.coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.02)


def stream(spark, folder, files=None):
    return parquet_stream(spark, str(folder), "*.parquet", files)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_queue_reads_each_line_once(spark, tmp_path):
    queue, state = tmp_path / "q", str(tmp_path / "s")
    df = spark.createDataFrame([(s,) for s in SENTENCES], "value string")
    df.coalesce(1).write.mode("append").text(str(queue))
    assert ST.queue_rows(R.read_text_stream(spark, str(queue)), state).count() == 4
    df.coalesce(1).write.mode("append").text(str(queue))
    assert ST.queue_rows(R.read_text_stream(spark, str(queue)), state).count() == 8


def test_word_count_two_rows_per_batch_and_restart(spark, tmp_path):
    queue, state = tmp_path / "q", str(tmp_path / "s")
    df = spark.createDataFrame(list(enumerate(SENTENCES * 3)), "seq bigint, text string")
    for i in range(3):
        put(df.where(F.floor(F.col("seq") / 2) == i), queue)
    ST.word_count(stream(spark, queue, 1), "text", state)
    for i in range(3, 6):
        put(df.where(F.floor(F.col("seq") / 2) == i), queue)
    got = ST.word_count(stream(spark, queue, 1), "text", state)
    assert rows(got) == rows(X.word_count(X.tokenize(df, "text")))


def basket_df(spark, seed=1, n=40):
    rnd = random.Random(seed)
    adds = [(i, True, sorted(rnd.sample(range(6), rnd.randint(1, 4)))) for i in range(n)]
    gone = [(n + i, False, ids) for i, (_, _, ids) in enumerate(rnd.sample(adds, n // 3))]
    return spark.createDataFrame(adds + gone, "seq bigint, is_add boolean, ids array<int>")


def test_pattern_counts(spark, tmp_path):
    df = basket_df(spark)
    for lo in range(0, 60, 20):
        put(df.where(f"seq >= {lo} and seq < {lo + 20}"), tmp_path / "q")
    got = SP.pattern_counts(stream(spark, tmp_path / "q", 1), str(tmp_path / "s"))
    assert rows(got) == rows(P.pattern_counts(P.net_baskets(df)))


def test_changelog_replays_to_the_batch_state(spark, tmp_path):
    df, t = basket_df(spark, 2), 4
    queue, state = tmp_path / "q", str(tmp_path / "s")
    for lo in range(0, 60, 15):
        put(df.where(f"seq >= {lo} and seq < {lo + 15}"), queue)
        # One run per file: every run continues the one before.
        log = SP.maximal_changelog(stream(spark, queue), t, state)
    now = {}
    for r in sorted(log.collect(), key=lambda r: r.batch_id):
        assert now.get(tuple(r.pattern), False) != r.is_maximal
        now[tuple(r.pattern)] = r.is_maximal
    want = P.maximal_patterns(P.frequent_patterns(P.net_baskets(df), t))
    assert {p for p, on in now.items() if on} == {tuple(r.pattern) for r in want.collect()}


def test_changelog_work_follows_the_batch(spark, tmp_path):
    """Many patterns known, then a batch of one small basket: it looks at that basket's subsets only."""
    queue, state = tmp_path / "q", str(tmp_path / "s")
    many = [(i, True, [10 * i + k for k in range(6)]) for i in range(200)]
    put(spark.createDataFrame(many, "seq bigint, is_add boolean, ids array<int>"), queue)
    looked = {}
    SP.maximal_changelog(stream(spark, queue), 1, state, looked.__setitem__)
    put(spark.createDataFrame([(900, False, [30, 31, 32, 33, 34, 35]), (901, True, [7001, 7002])], "seq bigint, is_add boolean, ids array<int>"), queue)
    log = SP.maximal_changelog(stream(spark, queue), 1, state, looked.__setitem__).where("batch_id = 1")
    assert looked == {0: 200 * 63, 1: 63 + 3}
    assert sorted((r.pattern, r.is_maximal, r.cnt) for r in log.collect()) == [([30, 31, 32, 33, 34, 35], False, 0), ([7001, 7002], True, 1)]
    # Patterns whose count and references are 0 left the state.
    left = SP.BucketTable(f"{state}/entries", SP.ENTRY, ["pattern"]).read(spark, 1)
    assert left.count() == 199 * 63 + 3 and left.where("array_contains(pattern, 31)").count() == 0


def test_changelog_at_every_batch(spark, tmp_path):
    """Random additions and removals in small batches: counts, references and maximal patterns as recomputed, files bounded."""
    df, t = basket_df(spark, 5, 60).withColumn("at", F.floor(F.col("seq") / 8)), 3
    queue, state = tmp_path / "q", str(tmp_path / "s")
    for at in range(10):
        put(df.where(f"at = {at}").drop("at"), queue)
    log = SP.maximal_changelog(stream(spark, queue, 1), t, state).collect()
    now = {}
    for n in range(10):
        for r in log:
            if r.batch_id == n:
                assert now.get(tuple(r.pattern), False) != r.is_maximal
                now[tuple(r.pattern)] = r.is_maximal
        want = P.maximal_patterns(P.frequent_patterns(P.net_baskets(df.where(f"at <= {n}")), t)) if n % 3 == 0 or n == 9 else None
        if want is not None:
            assert {p for p, on in now.items() if on} == {tuple(r.pattern) for r in want.collect()}
    entries = SP.BucketTable(f"{state}/entries", SP.ENTRY, ["pattern"]).read(spark, 9)
    counts = {tuple(r.pattern): r.cnt for r in P.pattern_counts(P.net_baskets(df)).collect()}
    assert {tuple(r.pattern): r.cnt for r in entries.where("cnt > 0").collect()} == counts
    refs = {tuple(r.pattern): r.ref_count for r in P.reference_counts(P.frequent_patterns(P.net_baskets(df), t)).collect()}
    assert {tuple(r.pattern): r.refs for r in entries.where(f"cnt >= {t}").collect()} == refs
    manifests = list((tmp_path / "s" / "entries" / "manifest").glob("v=*"))
    assert len(manifests) <= 3


def test_outlier_streams(spark, tmp_path):
    rnd = random.Random(3)
    data = [(s, rnd.randint(0, 7), [rnd.random(), rnd.random()], s) for s in range(90)]
    df = spark.createDataFrame(data, "seq bigint, id bigint, vector array<double>, time bigint")
    for lo in (0, 30, 60):
        put(df.where(f"seq >= {lo} and seq < {lo + 30}"), tmp_path / "q")
    axes = [[1.0, 0.0], [0.0, 1.0]]
    snaps = SO.snapshots(stream(spark, tmp_path / "q", 1), axes, 0.2, 3, str(tmp_path / "s1"))
    last = O.outlier_snapshot(O.project_vectors(O.latest_objects(df), axes), 0.2, 3)
    names = ["projection_id", "id", "neighbors", "is_outlier"]
    assert rows(snaps.where("batch_id = 2").select(names)) == rows(last.select(names))
    # The log of flips, replayed, agrees with the grid of all flags at its last arrival.
    projected = O.project_vectors(stream(spark, tmp_path / "q", 1), axes, ["seq", "id"])
    log = SO.flips(projected, 0.2, 3, str(tmp_path / "s2"))
    now = log.groupBy("projection_id", "obj_id").agg(F.max_by("is_outlier", "seq").alias("is_outlier"))
    grid = O.outliers_per_arrival(O.project_vectors(df, axes, ["seq", "id"]), 8, 0.2, 3).where("seq = 89")
    assert rows(now) == rows(grid.select("projection_id", "obj_id", "is_outlier"))


def test_merge_flags(spark, tmp_path):
    data = [(s, s % 3, p, o, (s + p + o) % 4 == 0) for s in range(12) for p in (0, 1) for o in range(3)]
    df = spark.createDataFrame(data, "seq bigint, id bigint, projection_id int, obj_id bigint, is_outlier boolean")
    df = df.withColumn("ts", F.timestamp_millis(F.col("seq") * 1000 + T0))
    put(df.where("projection_id = 0 or seq < 6"), tmp_path / "q")
    put(df.where("projection_id = 1 and seq >= 6 and seq < 11"), tmp_path / "q")
    got = SO.merge_flags(stream(spark, tmp_path / "q", 1), 2, "ts", "1 hour", str(tmp_path / "s"))
    assert rows(got.drop("ts")) == rows(O.outlier_merge(df.where("projection_id = 0 or seq < 11"), 2))


def test_cmv_windows(spark, tmp_path):
    rnd = random.Random(4)
    data = [(i * 700, rnd.choice("ab"), rnd.randint(1, 50) / 2) for i in range(200)]
    df = spark.createDataFrame(data, "time bigint, component string, ms double").withColumn("ts", SM.event_time(F.col("time")))
    put(df.where("time < 60000"), tmp_path / "q")
    put(df.where("time >= 60000"), tmp_path / "q")
    got = SM.drain_cmv_windows(stream(spark, tmp_path / "q", 1), "10 seconds", "1 minute", ["component"], str(tmp_path / "s"))
    assert rows(got) == rows(M.cmv_window(df, 10_000, ["component"]))


@pytest.mark.parametrize("outer", [True, False])
def test_trace_correlation(spark, tmp_path, outer):
    """Late executions still meet their completion; sentinels push the watermark."""
    done = [(t, 10 * t, T0 + t * 1000) for t in range(40)]
    ran = [(t, c, T0 + t * 1000 + d) for t in range(40) if t % 5 for c, d in (("a", 100), ("b", 90_000))]
    c = spark.createDataFrame(done, "trace bigint, latency bigint, at bigint").withColumn("done_at", F.timestamp_millis("at")).drop("at")
    e = spark.createDataFrame(ran, "trace bigint, component string, at bigint").withColumn("ran_at", F.timestamp_millis("at")).drop("at")
    put(c, tmp_path / "c")
    put(e, tmp_path / "e")
    for day in (1, 2):
        late = F.timestamp_millis(F.lit(T0 + day * 86_400_000))
        put(c.limit(1).withColumn("trace", F.lit(-day).cast("bigint")).withColumn("done_at", late), tmp_path / "c")
        put(e.limit(1).withColumn("trace", F.lit(-10 - day).cast("bigint")).withColumn("ran_at", late), tmp_path / "e")
    joined = SM.correlate_traces(stream(spark, tmp_path / "c", 1), stream(spark, tmp_path / "e", 1), keep_unmatched=outer)
    got = SM.drain(joined, "correlate", str(tmp_path / "s")).where("trace >= 0").select("trace", "latency", "component")
    want = M.correlate_traces(c, e, keep_unmatched=outer).select("trace", "latency", "component")
    assert rows(got) == rows(want)


def test_pair_latency(spark, tmp_path):
    data = [(t, t * 1000, t * 1000 + 500 + t, t % 4 == 0) for t in range(30)]
    df = spark.createDataFrame(data, "trace bigint, start bigint, end bigint, failed boolean")
    starts = df.select("trace", "start", F.timestamp_millis("start").alias("started_at"))
    outcomes = df.where("trace % 7 <> 0").select("trace", "end", "failed", F.timestamp_millis("end").alias("ended_at"))
    put(starts, tmp_path / "a")
    put(outcomes, tmp_path / "b")
    got = SM.drain(SM.pair_latency(stream(spark, tmp_path / "a"), stream(spark, tmp_path / "b")), "pairs", str(tmp_path / "s"))
    assert rows(got) == rows(M.pair_latency(starts, outcomes))


def test_latest_counters_as_of_every_batch(spark, tmp_path):
    """Maps merge key by key over stored ones, late points do not win, reads as of a batch agree, files stay bounded."""
    rnd = random.Random(6)
    schema = "task string, name string, ts bigint, value map<string,string>"
    parts = [[(rnd.choice("abc"), rnd.choice("xy"), rnd.randrange(1000), {rnd.choice("pqr"): str(rnd.random()) for _ in range(2)}) for _ in range(12)] for _ in range(9)]
    for part in parts:
        put(spark.createDataFrame(part, schema), tmp_path / "q")
    store = SM.latest_counters(stream(spark, tmp_path / "q", 1), ["task", "name"], "ts", str(tmp_path / "s"), keep=4)
    assert SM.last_batch(spark, str(tmp_path / "s")) == 8
    for n in (5, 7, 8):
        want = {}
        for task, name, ts, value in (r for part in parts[: n + 1] for r in part):
            for k, v in value.items():
                want[task, name, k] = max(want.get((task, name, k), (-1, "")), (ts, v))
        assert {(r.task, r.name, r.counter): (r.ts, r.value) for r in store.read(spark, n).collect()} == want
    versions = list((tmp_path / "s" / "store").glob("data/v=*/bucket=*/*.parquet"))
    assert len(list((tmp_path / "s" / "store" / "manifest").glob("v=*"))) == 4 and len(versions) <= 6 * 4


def test_folder_table_and_empty_source(spark, tmp_path):
    """A table stored as a folder is read whole; a run without input gives no rows."""
    spark.range(30).select(F.col("id"), F.lit("a b").alias("text")).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    assert drain_to_parquet(parquet_stream(spark, str(tmp_path), "t.parquet"), "folder").count() == 30
    none = parquet_stream(spark, str(tmp_path), "t.parquet").where("id < 0").groupBy("text").count()
    assert drain_updates(none, ["text"], "none").count() == 0
