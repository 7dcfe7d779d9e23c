import random

import pytest
from pyspark.sql import functions as F

from weir.operators import partitions as N
from weir.operators import transitions as S


def items(spark, n=7):
    return spark.range(n).select(F.lit("g").alias("grp"), F.col("id").alias("idx"), F.lit(1.0).alias("w"), F.lit(1.0).alias("size"))


@pytest.mark.parametrize("a, b, want", [((1, 3), (4, 6), 0), ((1, 5), (4, 6), 2), ((1, 4), (4, 6), 1), ((2, 4), (1, 6), 3), ((1, 6), (3, 5), 3)])
def test_range_overlap(spark, a, b, want):
    ranges = spark.createDataFrame([("g", "a", 1, *a), ("g", "b", 1, *b)], "grp string, plan_id string, bucket int, start int, end int")
    pairs = spark.createDataFrame([("a", "b")], "plan_a string, plan_b string")
    rows = N.plan_overlap(items(spark), ranges, pairs).collect()
    assert sum(r.overlap for r in rows) == want


def test_ranges_and_sizes(spark):
    sizes = spark.createDataFrame([("g", "p", 1, 3), ("g", "p", 2, 4), ("g", "p", 3, 5)], "grp string, plan_id string, bucket int, size int")
    r = N.sizes_to_ranges(sizes).orderBy("bucket")
    assert [(x.start, x.end) for x in r.collect()] == [(0, 2), (3, 6), (7, 11)]
    assert [x.size for x in N.ranges_to_sizes(r).orderBy("bucket").collect()] == [3, 4, 5]


def test_ratio_is_checked(spark):
    with pytest.raises(ValueError):
        N.load_cap(items(spark), 2, 1.0)


def test_move_cost_with_matching(spark):
    ranges = spark.createDataFrame([("g", "a", 1, 0, 3), ("g", "a", 2, 4, 6), ("g", "b", 1, 0, 1), ("g", "b", 2, 2, 6)], "grp string, plan_id string, bucket int, start int, end int")
    overlap = N.plan_overlap(items(spark), ranges, spark.createDataFrame([("a", "b")], "plan_a string, plan_b string"))
    assert N.plan_move_cost(items(spark), overlap).first().moved == 2.0
    swap = spark.createDataFrame([(1, 2), (2, 1)], "bucket_a int, bucket_b int")
    assert N.plan_move_cost(items(spark), overlap, swap).first().kept == 2.0
    steps = spark.createDataFrame([("g", "a", "b"), ("g", "a", "b"), ("g", "b", "b")], "grp string, plan_a string, plan_b string")
    c = N.chain_move_cost(steps, N.plan_move_cost(items(spark), overlap)).first()
    assert (c.steps, c.moved) == (3, 4.0)


def test_weighted_buckets_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot", i, float(rnd.randint(1, 9)), 1.0) for i in range(500)] + [("b", i, 1.0, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "grp string, idx bigint, w double, size double")
    got = {(r.grp, r.idx): r.bucket for r in N.weighted_buckets(df, 4, width=16).collect()}
    total, cum = sum(r[2] for r in rows if r[0] == "hot"), 0.0
    for g, i, w, _ in rows[:500]:
        cum += w
        assert got[(g, i)] == -(-cum * 4 // total)
    assert [got[("b", i)] for i in range(8)] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_neighbor_loop_counts_once(spark):
    t = spark.createDataFrame([("1", "1", 0.2), ("1", "2", 0.3), ("2", "1", 0.1), ("12", "3", 0.5)], "from_state string, to_state string, p double")
    got = {(r.state, r.neighbor): round(r.prob, 6) for r in S.neighbor_prob(t).collect()}
    assert got[("1", "1")] == round(0.2 / 0.6, 6) and got[("1", "2")] == round(0.4 / 0.6, 6)
    assert ("1", "3") not in got and got[("2", "1")] == 1.0


def test_transition_freq(spark):
    rows = [("e", i, s) for i, s in enumerate("abab")] + [("f", 0, "b")]
    df = spark.createDataFrame(rows, "entity string, seq bigint, state string")
    assert {(r.from_state, r.to_state): (r.cnt, r.p) for r in S.transition_freq(df).collect()} == {("a", "b"): (2, 0.4), ("b", "a"): (1, 0.2)}


def test_items_are_not_shuffled_by_group(spark):
    ranges = spark.createDataFrame([("g", 1, 1, 0, 3), ("g", 1, 2, 4, 6), ("g", 2, 1, 0, 6)], "grp string, plan_id int, bucket int, start int, end int")
    mine = items(spark).withColumn("grp", F.when(F.col("idx") < 99, "g").otherwise("h"))
    for df in (N.piece_sums(mine, ranges, "w"), N.assign_buckets(mine, ranges), N.load_cap(mine, 2), N.plan_feasible(mine, ranges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.lo, r.w) for r in N.piece_sums(mine, ranges, "w").collect()) == [(0, 4.0), (4, 3.0)]


def test_gaps_between_buckets_count_nowhere(spark):
    ranges = spark.createDataFrame([("g", 1, 1, 0, 1), ("g", 1, 2, 4, 6), ("g", 2, 1, 1, 5)], "grp string, plan_id int, bucket int, start int, end int")
    pairs = spark.createDataFrame([(1, 2)], "plan_a int, plan_b int")
    got = {(r.bucket_a, r.bucket_b): r.overlap for r in N.plan_overlap(items(spark), ranges, pairs).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 2.0}
    assert {(r.plan_id, r.bucket): r.load for r in N.bucket_loads(items(spark), ranges).collect()} == {(1, 1): 2.0, (1, 2): 3.0, (2, 1): 5.0}
