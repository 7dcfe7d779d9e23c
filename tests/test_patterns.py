import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weir.functions import arrays as A
from weir.operators import patterns as P
from weir.operators import text as X

# Sample baskets and dictionary.
BASKETS = ["a b c", "a b d", "a b c d", "c d", "c d e", "a c d", "a b c d e", "a b c d e f", "a b c d e f g"]
WORDS = "abcdefg"


@pytest.fixture(scope="module")
def dictionary(spark):
    return P.dictionary_from_lines(spark.createDataFrame(list(enumerate(WORDS)), "seq bigint, word string"))


@pytest.fixture(scope="module")
def baskets(spark, dictionary):
    df = spark.createDataFrame(list(enumerate(BASKETS)), "seq bigint, t string").withColumn("is_add", F.lit(True))
    return P.basket_ids(X.basket_words(df, "t", ["seq", "is_add"]), dictionary)


def named(df):
    return {"".join(WORDS[i] for i in r.pattern): r.cnt for r in df.collect()}


def test_dictionary_keeps_last_line(spark):
    lines = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "seq bigint, word string")
    assert {r.word: r.id for r in P.dictionary_from_lines(lines).collect()} == {"x": 2, "y": 1}


def test_subsets(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([7],)], "ids array<int>")
    every = [r.pattern for r in P.expand_subsets(df).collect()]
    assert every == [[1], [2], [1, 2], [3], [1, 3], [2, 3], [1, 2, 3], [7]]
    assert [r.pattern for r in P.expand_subsets(df, proper=True).collect()] == every[:6]


def test_subsets_of_a_wide_basket_come_in_chunks(spark):
    df = spark.createDataFrame([(list(range(13)),), ([1],)], "ids array<int>")
    rows = [tuple(r.pattern) for r in P.expand_subsets(df).collect()]
    assert len(rows) == 2**13 and len(set(rows)) == 2**13 - 1 and all(r == tuple(sorted(r)) for r in rows)
    assert P.expand_subsets(df, proper=True).count() == 2**13 - 2


def test_forty_items(spark):
    """Two baskets of 40 items that share three: no row holds all subsets."""
    a, b = list(range(40)), [0, 1, 2] + list(range(100, 137))
    df = spark.createDataFrame([(a, True), (b, True), (b, True), (b, False)], "ids array<int>, is_add boolean")
    frequent = P.frequent_patterns(P.net_baskets(df), 2)
    assert {tuple(r.pattern) for r in P.maximal_patterns(frequent).collect()} == {(0, 1, 2)} and frequent.count() == 7


def test_sample_counts(baskets):
    rows = P.expand_subsets(baskets)
    assert (rows.count(), rows.distinct().count()) == (267, 127)


@pytest.mark.parametrize("t, n, maximal", [
    (3, 31, {"abcde": 3}), (4, 19, {"abcd": 4, "cde": 4}), (5, 13, {"abc": 5, "abd": 5, "acd": 5}),
])
def test_sample_patterns(baskets, t, n, maximal):
    net = P.net_baskets(baskets)
    frequent = P.frequent_patterns(net, t)
    assert frequent.count() == n
    assert named(P.frequent_patterns(net, t)) == named(frequent)
    assert named(P.maximal_patterns(frequent)) == maximal
    assert named(P.reference_counts(frequent).where("ref_count = 0")) == maximal


@pytest.mark.parametrize("t, changes", [
    (4, {"abcd": False, "cde": False, "abc": True, "abd": True, "acd": True}), (3, {"abcde": False, "abcd": True, "cde": True}),
])
def test_sample_changelog(spark, baskets, t, changes):
    removed = baskets.unionByName(baskets.where("seq = 8").withColumn("is_add", F.lit(False)))
    before, after = (P.maximal_patterns(P.frequent_patterns(P.net_baskets(b), t)) for b in (baskets, removed))
    got = {"".join(WORDS[i] for i in r.pattern): r.is_maximal for r in P.maximal_changes(before, after).collect()}
    assert got == changes


def test_unknown_ids_have_null_words(spark, dictionary):
    df = spark.createDataFrame([([0, 9, 2], 1)], "pattern array<int>, cnt int")
    assert P.pattern_words(df, dictionary).first().words == ["a", None, "c"]


def test_drop_one(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],)], "p array<int>")
    assert [r[0] for r in df.select(A.drop_one_subsets("p")).collect()] == [[[2, 3], [1, 3], [1, 2]], []]


@pytest.mark.parametrize("seed", [3, 4])
def test_clamped_counts_match_replay(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.random() < 0.5, sorted(rnd.sample(range(4), rnd.randint(1, 3)))) for i in range(60)]
    count = Counter()
    for _, add, ids in rows:
        for k in range(1, len(ids) + 1):
            for p in combinations(ids, k):
                count[p] = count[p] + 1 if add else max(count[p] - 1, 0)
    got = P.clamped_pattern_counts(spark.createDataFrame(rows, "seq bigint, is_add boolean, ids array<int>"))
    assert {tuple(r.pattern): r.cnt for r in got.collect()} == {p: c for p, c in count.items() if c > 0}


def test_level_miner_on_wide_baskets(spark):
    """30 items per basket, one pattern repeated."""
    rnd = random.Random(5)
    rows = [(sorted({1, 2, 3} | set(rnd.sample(range(10, 500), 27))), 1) for _ in range(40)]
    net = spark.createDataFrame(rows, "ids array<int>, n bigint")
    got = {tuple(r.pattern): r.cnt for r in P.frequent_patterns(net, 30).collect()}
    assert got == {p: 40 for k in (1, 2, 3) for p in combinations((1, 2, 3), k)}


def test_wide_baskets_alone_take_the_long_path(spark):
    """Of two widths, each basket gives its subsets; the narrow one is not cut in chunks."""
    df = spark.createDataFrame([(1, list(range(12))), (2, [3, 5]), (3, None), (4, [])], "k int, ids array<int>")
    rows = P.expand_subsets(df, keep=["k"])
    got = Counter((r.k, tuple(r.pattern)) for r in rows.collect())
    want = Counter((k, c) for k, ids in ((1, range(12)), (2, (3, 5))) for n in range(1, 13) for c in combinations(ids, n))
    assert got == want and "Union" in rows._jdf.queryExecution().toString()
    assert "lambda" not in df.select(A.joined("ids"))._jdf.queryExecution().toString()


def test_clamped_counts_over_blocks(spark):
    rnd = random.Random(11)
    rows = [(k, sorted(rnd.sample(range(4), rnd.randrange(1, 4))), rnd.random() < 0.5) for k in range(60)]
    want = Counter()
    for _, ids, add in rows:
        for n in range(1, len(ids) + 1):
            for c in combinations(ids, n):
                want[c] = max(0, want[c] + (1 if add else -1))
    counts = P.clamped_pattern_counts(spark.createDataFrame(rows, "seq bigint, ids array<int>, is_add boolean"), width=7)
    assert {tuple(r.pattern): r.cnt for r in counts.collect()} == {c: n for c, n in want.items() if n > 0}
    assert "Join" not in counts._jdf.queryExecution().toString()


def replayed(rows):
    count = Counter()
    for _, ids, add in sorted(rows, key=lambda r: r[0]):
        for n in range(1, len(ids) + 1):
            for c in combinations(ids, n):
                count[c] = max(0, count[c] + (1 if add else -1))
    return {c: n for c, n in count.items() if n > 0}


@pytest.mark.parametrize("limits", [{}, {"most": 40, "rows": 64}, {"width": 5, "rows": 16}])
def test_clamped_counts_over_segments(spark, limits):
    """More items than a mask holds, baskets of more subsets than are made at a time, arrivals in no order of files; empty and missing baskets."""
    rnd = random.Random(21)
    rows = [(k * 3 - 200, sorted(rnd.sample(range(-5, 5) if k % 3 else range(70), rnd.randrange(1, 6))), rnd.random() < 0.6) for k in range(300)]
    rows += [(10_000, list(range(9)), True), (10_001, list(range(1, 9)), False), (-900, [2, 69], False)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (5, [], True), (6, None, True)], "seq bigint, ids array<int>, is_add boolean")
    got = P.clamped_pattern_counts(df, **limits).collect()
    assert len(got) == len({tuple(r.pattern) for r in got})
    assert {tuple(r.pattern): r.cnt for r in got} == replayed(rows)


def test_a_range_of_arrivals_moves_each_pattern_once(spark):
    """A thousand baskets of three items give 7 rows, not 7,000."""
    df = spark.range(1000).selectExpr("array(4, 7, 9) AS ids", "id % 3 > 0 AS is_add").coalesce(1)
    sums = df.mapInArrow(P._segment_sums(1000, 1000, 1000), "pattern array<int>, block bigint, total bigint, low bigint").collect()
    assert sorted(tuple(r.pattern) for r in sums) == sorted(c for n in (1, 2, 3) for c in combinations((4, 7, 9), n))
    assert {(r.total, r.low) for r in sums} == {(332, -1)}


def test_folded_baskets_and_both_ways_to_mine(spark):
    rnd = random.Random(12)
    rows = [(sorted(rnd.sample(range(6), rnd.randrange(1, 6))), add) for k in range(80) for add in ([True, False] if k % 5 == 0 else [True])]
    df = spark.createDataFrame(rows, "ids array<int>, is_add boolean")
    as_dict = lambda d, c: {tuple(r["ids" if c == "n" else "pattern"]): r[c] for r in d.collect()}
    net = P.net_baskets(df)
    assert as_dict(P.net_baskets(P.folded_baskets(df), "rows"), "n") == as_dict(net, "n")
    once, by_level = (as_dict(P.frequent_patterns(net, 5, most), "cnt") for most in (256, 0))
    assert once and once == by_level
