"""Planted near copies of known similarity, groups in one bucket, nulls."""

import random

from weir.llm import neardup

from .test_llm import docs


def jaccard(a, b):
    a, b = (set(neardup.shingles(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def planted(at, pairs, seed=3):
    """(text, near copy) with a similarity of ``at`` or a little more: words are replaced as long as that holds."""
    rnd = random.Random(seed)
    out = []
    for k in range(pairs):
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(300)]
        copy = list(words)
        while True:
            spot, new = rnd.randrange(300), f"n{rnd.randrange(10 ** 6)}"
            changed = copy[:spot] + [new] + copy[spot + 1 :]
            if jaccard(" ".join(words), " ".join(changed)) < at:
                break
            copy = changed
        out.append((" ".join(words), " ".join(copy)))
    return out


def recall(spark, stage, at, pairs=300):
    """Share of the planted copies that a stage drops."""
    rows = [(2 * k + j, t, "a") for k, pair in enumerate(planted(at, pairs)) for j, t in enumerate(pair)]
    return (len(rows) - stage(docs(spark, rows)).count()) / pairs


def test_stage_drops_planted_copies(spark):
    import corpus_pipeline as P

    for at in (0.8, 0.9, 0.95):
        assert recall(spark, lambda d: P.drop_near_duplicates(spark, d, ""), at, 100) >= 0.98, at


def test_pairs_below_the_limit_stay(spark):
    rows = [(2 * k + j, t, "a") for k, pair in enumerate(planted(0.7, 50)) for j, t in enumerate(pair) if jaccard(*pair) < 0.8]
    assert neardup.deduplicate(docs(spark, rows)).count() == len(rows) > 50


def test_large_group_and_odd_rows(spark):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    group = []
    for i in range(300):
        words = list(base)
        for _ in range(rnd.randrange(1, 6)):
            words[rnd.randrange(400)] = f"e{rnd.randrange(10 ** 6)}"
        group.append((100 + i, " ".join(words), "a"))
    rows = group + [(1, None, "a"), (2, "", "a"), (None, "one two three", "a"), (3, "one  Two three", "a"), (3, "one  Two three", "a"), (4, " ".join(base), "a"), (5, "alone", "a")]
    kept = neardup.deduplicate(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5]
    assert neardup.deduplicate(docs(spark, [])).count() == 0


def template_pages(pairs, changed=44, seed=6):
    """Pages of one template, each with a near copy: words of its own at random places, three blocks of six changed in the copy."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(300)]
    out = []
    for _ in range(pairs):
        page = list(base)
        for at in range(0, 300, 300 // (changed // 5)):
            page[at] = f"p{rnd.randrange(10 ** 8)}"
        copy = list(page)
        for at in (20, 120, 220):
            copy[at : at + 6] = [f"c{rnd.randrange(10 ** 8)}" for _ in range(6)]
        out.append((" ".join(page), " ".join(copy)))
    return out


def test_pages_of_a_template(spark):
    """Crowded buckets: pages alike below the limit stay, every near copy among them goes."""
    pages = template_pages(300)
    assert all(jaccard(*p) >= 0.8 for p in pages[:20])
    assert all(jaccard(pages[k][i], pages[k + 1][j]) < 0.8 for k in range(20) for i in (0, 1) for j in (0, 1))
    rows = [(2 * k + j, t, "a") for k, pair in enumerate(pages) for j, t in enumerate(pair)]
    kept = neardup.deduplicate(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [2 * k for k in range(300)]


def test_prefix_pairs_miss_no_alike_pair(spark):
    """Random sets over few shingles, at both levels of the prefixes, against all pairs."""
    rnd = random.Random(8)
    base = [sorted(rnd.sample(range(400), 90)) for _ in range(6)]
    sets = []
    for k in range(150):
        own = set(base[k % 6])
        for _ in range(rnd.randrange(12)):
            own.discard(rnd.choice(sorted(own)))
            own.add(rnd.randrange(400))
        sets.append(own)
    want = {frozenset((i, j)) for i in range(150) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}
    tokens = spark.createDataFrame([(i, len(s), w) for i, s in enumerate(sets) for w in s], "sh long, size int, w long")
    roots = spark.createDataFrame([(i, i) for i in range(150)], "sh long, root long")
    for wide in (64, 0):
        got = {frozenset((r["a"], r["b"])) for r in neardup.prefix_pairs(tokens, roots, wide).collect()}
        assert want and want <= got, wide


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "one two three four five six", "b"), (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (None, None, "z"), (None, None, "y")]
    df = docs(spark, rows).withColumn("__key", F.lit(1)).withColumn("sh", F.lit(2)).withColumn("root", F.lit(3)).withColumn("n", F.lit(4))
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["source"]) for r in kept.collect()) == [(False, "a"), (True, "y")]


def test_fingerprints_are_a_band(spark):
    """Sets whose fingerprints differ in three bits share one band more, those further apart don't; the empty set has none."""
    rows = [(1, [5], 0b0), (2, [6], 0b111), (3, [7], 0b111111), (4, [8], -1), (5, [], 0)]
    df = spark.createDataFrame(rows, "sh long, bands array<long>, fp long")
    got = {r["sh"]: r["bands"] for r in neardup.with_print_band(df).collect()}
    assert got[1][1] == got[2][1] == got[3][1] != got[4][1] and got[5] == []
    assert all(got[k][0] == 4 + k and len(got[k]) == 2 for k in (1, 2, 3, 4))
