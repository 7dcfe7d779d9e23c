"""Composed jobs on small inputs."""

from pyspark.sql import functions as F

from weir.operators import patterns as P
from weir.plans import jobs as J

from .test_patterns import BASKETS, WORDS
from .test_text import SENTENCES


def test_word_count_job(spark):
    df = spark.createDataFrame([(s,) for s in SENTENCES], "text string")
    assert {r.word: r.cnt for r in J.word_count_job(df).where("cnt > 1").collect()} == {"the": 4, "and": 2}


def test_pattern_job(spark):
    dictionary = P.dictionary_from_lines(spark.createDataFrame(list(enumerate(WORDS)), "seq bigint, word string"))
    lines = [(i, "+" + b) for i, b in enumerate(BASKETS)] + [(8, "-" + BASKETS[8]), (20, "+unknown words")]
    out = J.pattern_job(spark.createDataFrame(lines, "seq bigint, text string"), dictionary, 4)
    assert {("".join(r.words), r.cnt) for r in out.collect()} == {("abc", 4), ("abd", 4), ("acd", 4)}


def test_outlier_job(spark):
    # Object 4 first sits with the others and then moves away.
    rows = [f"{i}|{i}|{0.1 * i},1.0" for i in range(5)] + ["9|9|7.0,1.0"]
    out = J.outlier_job(spark.createDataFrame([(r,) for r in rows], "text string"), 5, [[1.0, 0.0], [0.0, 1.0]], 0.5, 2)
    assert {r.id: r.is_outlier for r in out.collect()} == {0: False, 1: False, 2: False, 3: False, 4: True}


def test_load_job(spark):
    def line(task, time, n, total, arrivals):
        return (f'bolt:{task}:{time}->{{"execute":{{"s:default":"{n},{total},0.0"}},"recv-queue":{{"sampleCount":2,"totalQueueLen":10,"totalCount":{arrivals}}}}}',)

    lines = spark.createDataFrame([line(0, 10, 10, 50.0, 101), line(1, 10, 10, 150.0, 101), line(0, 20, 30, 90.0, 301), line(7, 20, 1, 1.0, 1)], "text string")
    cluster = spark.range(2).select(F.lit("bolt").alias("component"), F.col("id").cast("int").alias("task"))
    now, past = J.load_job(lines, cluster, 10.0)
    got = {r.cycle: r for r in now.collect()}
    assert got[10].arrival_rate == 10.1 and got[10].lam == 20.2 and got[10].avg_ms == 10.0 and got[10].mu == 100.0
    # Task 1 keeps its report of cycle 10: (301 + 101) / 2 arrivals in cycle 20.
    assert round(got[20].arrival_rate, 6) == 20.1 and got[20].avg_ms == 6.0 and got[20].input_ratio == 10.0
    assert {r.cycle: round(r.avg_ms, 6) for r in past.collect()} == {10: 10.0, 20: round((200 + 240) / 60, 6)}
