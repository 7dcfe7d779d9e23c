import random

import pytest
from pyspark.sql import functions as F

from weir.functions import cmv
from weir.operators import telemetry as M
from weir.sources import metric_lines as L

# Sample telemetry lines with the older queue names.
LINES = [
    'objectSpout:4->{"receive":{"sampleCount":209,"totalQueueLen":212,"totalCount":4170},"complete-latency":{"default":"2086,60635.0,3382707.0"},"sendqueue":{"sampleCount":420,"totalQueueLen":424,"totalCount":8402}}',
    'projection:7->{"receive":{"sampleCount":52,"totalQueueLen":53,"totalCount":1052},"sendqueue":{"sampleCount":2152,"totalQueueLen":4514,"totalCount":43052},"execute":{"objectSpout:default":"525,709.4337659999997,1120.8007487084597"}}',
    'detector:3->{"receive":{"sampleCount":2769,"totalQueueLen":6088758,"totalCount":55416},"sendqueue":{"sampleCount":8921,"totalQueueLen":11476,"totalCount":178402},"execute":{"projection:default":"49200,5167.623237000047,721.6383647758853"}}',
    'updater:9->{"receive":{"sampleCount":3921,"totalQueueLen":5495,"totalCount":78436},"sendqueue":{"sampleCount":4001,"totalQueueLen":4336,"totalCount":80002},"execute":{"detector:default":"40000,1651.7782049999894,182.68124734051045"}}',
    "no json", "a:1->{broken", 'a:1->{"recv-queue":{"sampleCount":1}}',
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "text string")


def test_sample_lines(lines):
    got = {r.cid: (r.type, r.cnt, round(r.avg, 5), round(r["var"], 5)) for r in M.process_stats(L.parse_window(lines)).collect()}
    assert got == {
        "objectSpout:4": ("spout", 2086, 29.06759, 776.69869), "projection:7": ("bolt", 525, 1.3513, 0.30884),
        "detector:3": ("bolt", 49200, 0.10503, 0.00364), "updater:9": ("bolt", 40000, 0.04129, 0.00286),
    }


def test_queue_names(lines):
    assert M.queue_stats(L.parse_window(lines)).count() == 0
    rows = M.queue_stats(L.parse_window(lines, strict=False)).collect()
    lengths = {r.cid: r.avg for r in rows if r.metric == "recv-queue-length"}
    assert round(lengths["detector:3"], 1) == 2198.9 and len(rows) == 24


def test_empty_windows_are_counted(spark):
    df = spark.createDataFrame([("a", 2, 3.0, 5.0), ("a", 0, 9.0, 9.0)], "k string, cnt bigint, total double, total_2 double")
    r = M.cmv_merge_windows(df, ["k"]).first()
    assert (r.cnt, r.total, r.total_2, r["empty"]) == (2, 3.0, 5.0, 1)
    z = M.cmv_stats(spark.createDataFrame([(0, 0.0, 0.0)], "cnt bigint, total double, total_2 double")).first()
    assert (z.avg, z.avg2, z["var"], z.scv) == (0.0, 0.0, 0.0, 0.0)


def test_cmv_strings(spark):
    df = spark.createDataFrame([(2, 6.0, 20.0, 1)], "cnt bigint, total double, total_2 double, empty bigint")
    r = df.select(cmv.long_string().alias("l"), cmv.short_string().alias("s")).first()
    assert r.l == "Count: 2, sum: 6.00, avg: 3.00000, var: 1.00000, scv: 0.11111, empEn: 1"
    assert r.s == "cnt:2,avg:3.00,scv:0.11"


def test_traced_layouts(spark):
    text = ['{"_complete-latency": 9, "a": ["s:d,10,15", "s:d,20,4,31"]}', "{bad", '{"a": ["s:d,1,2"]}']
    df = spark.createDataFrame([(t,) for t in text], "text string")
    rows = {(r.component, r.duration, r.service) for r in L.parse_traced(df).collect()}
    assert rows == {("_complete-latency", 9.0, None), ("a", 1.0, None), ("a", 5.0, None), ("a", 11.0, 4.0)}
    avg = {r.component: r.avg for r in M.traced_avg_simple(df).collect()}
    assert avg["_complete-latency"] == 4.0 and round(avg["a"], 3) == round((10 + 20 + 1) / 3, 3)
    none = M.traced_avg_simple(df.where("text = '{bad'")).collect()
    assert [(r.component, r.avg) for r in none] == [("_complete-latency", None)]


def test_encoded_names_survive(spark):
    df = spark.createDataFrame([("c", 1, 'odd"name', "1"), ("c", 1, "b", '{"x":2}')], "component string, task int, name string, v string")
    line = L.encode_lines(df, ["component", "task"], "name", "v")
    text = line.select(L.window_layout(F.col("component"), F.col("task"), F.col("json")).alias("line"))
    back = L.parse_encoded(text, "line").first()
    assert (back.component, back.task, back.metrics) == ("c", 1, {'odd"name': "1", "b": '{"x":2}'})


def test_even_groups(spark):
    df = spark.range(10).select(F.lit("a").alias("c"), F.col("id").alias("t"))
    sizes = M.even_groups(df, 4, ["c"], "t").groupBy("tile").count().orderBy("tile").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]
    few = M.even_groups(df.where("t < 3"), 5, ["c"], "t").orderBy("t").collect()
    assert [r.tile for r in few] == [1, 2, 3]


def test_ffill_and_history(spark):
    rows = [("a", 0, 10, 1), ("a", 0, 40, 2), ("b", 1, 20, 5), ("b", 1, 50, 6)]
    df = spark.createDataFrame(rows, "component string, task int, cycle bigint, v int")
    got = sorted((r.component, r.cycle, r.v) for r in M.snapshot_ffill(df, ["component", "task"]).collect())
    assert got == [("a", 10, 1), ("a", 20, 1), ("a", 40, 2), ("a", 50, 2), ("b", 20, 5), ("b", 40, 5), ("b", 50, 6)]
    hist = spark.createDataFrame([("a", c, 1, float(c), 0.0, 0) for c in (1, 2, 5, 9, 20, 21)], "k string, cycle bigint, cnt bigint, total double, total_2 double, empty bigint")
    out = M.rolling_history(hist, ["k"], size=4, width=3).orderBy("cycle").collect()
    assert [(r.cycle, r.total, r.cycles) for r in out] == [(1, 1.0, 1), (2, 3.0, 2), (5, 8.0, 3), (9, 17.0, 4), (20, 36.0, 4), (21, 55.0, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_segments_match_replay(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("aab"), rnd.randint(0, 3000), 1.0) for _ in range(400)]
    want = {}
    for c in "ab":
        mine = sorted(r for r in rows if r[0] == c)
        cuts = [mine[0][1]]
        for _, t, _ in mine:
            if t - cuts[-1] > 100:
                cuts.append(t)
        for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(c, i + 1)] = (s, e, sum(1 for _, t, _ in mine if s <= t < e))
    df = spark.createDataFrame(rows, "component string, time bigint, v double")
    got = {(r.component, r.segment): (r.start_time, r.end_time, r.cnt) for r in M.greedy_segments(df, 100, "v", width_ms=64).collect()}
    assert got == want


def test_hot_traces_keep_every_record(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), F.when(F.col("id") < 90, "hot").otherwise("cold").alias("trace"), F.lit("c").alias("component"), F.lit(5).cast("bigint").alias("at"))
    rows = M.collect_traces(df, 10, F.format_string("%03d", "seq"), "seq", "at").collect()
    hot = sorted((r.pos, r.record) for r in rows if r.trace == "hot")
    assert hot == [(i + 1, f"{i:03d}") for i in range(90)]
    assert sorted(r.pos for r in rows if r.trace == "cold") == list(range(1, 11))


def test_ordinary_lines_of_any_form(spark):
    lines = [
        'a-b:x1:9->{"execute":{"s:default":"2,4.0,8.0"},"emit":5,"acked":[1,2]}',
        'c:2->{"complete-latency":{"s":"1,1.0,1.0"},"execute":{"s":"3,5.0,9.0"}}',
        'c:3->{"execute":{"s":"x,1","t":"1,2.0,4.0"}}', "no line", 'd:1->{"execute":7}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    parsed = L.parse_window(df).collect()
    assert [(r.component, r.task, r.time, r.cid, r.type) for r in parsed] == [
        ("a-b", None, 9, "a-b:x1", "bolt"), ("c", 2, None, "c:2", "spout"), ("c", 3, None, "c:3", "bolt"), ("d", 1, None, "d:1", "bolt")]
    got = {(r.cid, r.stream): (r.cnt, r.avg) for r in M.process_stats(L.parse_window(df)).collect()}
    assert got[("c:2", "s")] == (4, 1.5) and got[("c:3", "t")] == (1, 2.0) and got[("a-b:x1", "s:default")] == (2, 2.0)
    texts = ['[word-counter-3]:{"k":"v"}', 'comp-x:3:99->{"k":"v"}', '[a-b-4]:77:{"k":"v"}']
    back = L.parse_encoded(spark.createDataFrame([(x,) for x in texts], "line string"), "line").collect()
    assert [(r.component, r.task, r.time) for r in back] == [("word-counter", 3, None), ("comp-x", 3, 99), ("a-b", 4, 77)]


def test_correlate_keeps_every_row(spark):
    done = spark.createDataFrame([(1, 10), (2, 20)], "trace bigint, latency bigint")
    ran = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (3, "c", 7)], "trace bigint, component string, arrival bigint")
    rows = M.correlate_traces(done, ran).collect()
    assert {(r.trace, r.latency, r.component) for r in rows} == {(1, 10, "a"), (1, 10, "b"), (2, 20, None)}
    assert M.correlate_traces(done, ran, keep_unmatched=False).count() == 2


def test_selection_of_lists_and_system_components(spark):
    df = spark.createDataFrame(
        [("c", "m", ["x"]), ("c", "m", []), ("c", "m", None), ("__sys", "m", ["x"]), ("c", "other", ["x"])],
        "component string, name string, value array<string>",
    )
    assert L.select_metrics(df, ["m"]).count() == 1


def test_sampling_is_deterministic(spark):
    df = spark.range(10_000).select(F.col("id").alias("trace"))
    n = M.sample_traces(df, "trace", 10).count()
    assert 800 < n < 1200 and M.sample_traces(df.repartition(7), "trace", 10).count() == n
