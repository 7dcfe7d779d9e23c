"""Ordered scans, skewed groups, and plan shapes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from weir.scale import GroupCount, GroupSum, Lag, LastValue, RowNumber, RunningSum, dense_index, dense_int_index, ordered_scan, range_scan

from .conftest import SMALL

SPECS = [
    RowNumber("rn"), RunningSum("rs", "v"), Lag("prev", "v"), LastValue("last", "w"), GroupCount("n"), GroupSum("total", "v"),
]


def naive(rows):
    out, groups = {}, {}
    for g, t, v, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        groups.setdefault(g, []).append((t, v, w))
    for g, items in groups.items():
        run, last, prev = 0, None, None
        for i, (t, v, w) in enumerate(items):
            run += v
            last = w if w is not None else last
            out[(g, t)] = (i + 1, run, prev, last, len(items), sum(x[1] for x in items))
            prev = v
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("how", ["width", "range"])
def test_scan_matches_naive(spark, seed, how):
    rnd = random.Random(seed)
    # One group holds most rows, one has a null key.
    rows = [
        (rnd.choice(["hot"] * 8 + ["a", "b", None]), t, rnd.randint(-5, 5), rnd.choice([None, None, t]))
        for t in rnd.sample(range(-500, 1500), 400)
    ]
    df = spark.createDataFrame(rows, "g string, t bigint, v bigint, w bigint")
    got = ordered_scan(df, ["g"], ["t"], SPECS, width=7) if how == "width" else range_scan(df, ["g"], ["t"], SPECS)
    got = {(r.g, r.t): (r.rn, r.rs, r.prev, r["last"], r.n, r.total) for r in got.collect()}
    assert got == naive(rows)


def test_hot_group_is_cut_into_blocks(spark):
    name = F.substring(F.concat(F.lit("hot"), F.col("id").cast("string")), 1, 3)
    df = spark.range(5000).select(name.alias("g"), F.col("id").alias("t"))
    plan = ordered_scan(df, ["g"], ["t"], [RowNumber("rn")], width=100)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # The row window works per (group, block).
    assert re.search(r"row_number\(\) windowspecdefinition\(g#\d+, __block", text)
    assert plan.agg(F.max("rn")).first()[0] == 5000


def test_dense_index(spark):
    df = spark.createDataFrame([(s,) for s in ("b", "a", "d", "c")], "word string")
    assert {r.word: r.i for r in dense_index(df, ["word"], "i").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    gaps = spark.createDataFrame([(5,), (100,), (-3,)], "seq bigint")
    assert {r.seq: r.i for r in dense_int_index(gaps, "seq", "i", width=10).collect()} == {-3: 0, 5: 1, 100: 2}


def test_sparse_ids_are_cut_by_rank(spark):
    ids = sorted(random.Random(3).sample(range(-(10**17), 10**17), 500))
    df = spark.createDataFrame([(i,) for i in ids], "seq bigint").repartition(3)
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    by_rank = dense_int_index(df, "seq", "i", most_blocks=100)
    # Blocks are the partitions of a range shuffle that is written once; they aren't computed from ids.
    assert "/ 1000000" in plan(dense_int_index(df, "seq", "i")) and "/ 1000000" not in plan(by_rank)
    assert {r.seq: r.i for r in by_rank.collect()} == {x: i for i, x in enumerate(ids)}
    assert dense_int_index(df.limit(0), "seq", "i", most_blocks=0).count() == 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["scan_range"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,100)" in plan and "LessThan(event_id,5100)" in plan
    plan = queries()["batch_by_time"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
