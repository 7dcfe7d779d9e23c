import random

import pytest

from weir.operators import outliers as O


def test_walsh_rows():
    rows = O.walsh_rows(8, 64)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert sum(x * y for x, y in zip(a, b)) == (1.0 if i == j else 0.0)


def test_length_mismatch_fails(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>")
    with pytest.raises(Exception, match="differ in length"):
        O.project_vectors(df, [[1.0, 2.0, 3.0]], ["id"]).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbors_match_pairs(spark, seed):
    """Many equal values in one projection, and ties at the distance itself."""
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), rnd.choice([0.5] * 6 + [x / 4 for x in range(-8, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, projection_id int, projection_value double")
    got = {r.id: r.neighbors for r in O.neighbor_counts(df, 0.5).collect()}
    for i, p, v in rows:
        assert got[i] == sum(1 for j, q, w in rows if p == q and j != i and abs(v - w) <= 0.5)


def test_latest_objects(spark):
    df = spark.createDataFrame([(1, 7, [1.0], 10), (3, 7, [3.0], 30), (2, 7, [2.0], 20), (4, 8, [4.0], 40)], "seq bigint, id bigint, vector array<double>, time bigint")
    assert {(r.id, r.seq, r.time) for r in O.latest_objects(df).collect()} == {(7, 3, 30), (8, 4, 40)}


def replay(rows, objects, distance, least):
    """Keep one position per object, count pairs anew at each arrival."""
    out, positions = {}, {}
    for seq, i, p, v in sorted(rows):
        pos = positions.setdefault(p, {})
        ready = len(pos) == objects
        pos[i] = v
        for o in range(objects) if ready else ():
            n = sum(1 for q in pos if q != o and abs(pos[q] - pos[o]) <= distance)
            out[(seq, p, o)] = (n, n < least)
    return out


@pytest.mark.parametrize("width", [16, 4096])
def test_per_arrival_matches_replay(spark, width):
    rnd = random.Random(9)
    rows, seq = [], 0
    for _ in range(150):
        i = rnd.randint(0, 11)
        for p in (0, 1):
            rows.append((seq, i, p, rnd.random()))
        seq += 1
    df = spark.createDataFrame(rows, "seq bigint, id bigint, projection_id int, projection_value double")
    got = {(r.seq, r.projection_id, r.obj_id): (r.neighbors, r.is_outlier) for r in O.outliers_per_arrival(df, 12, 0.2, 3, width).collect()}
    assert got == replay(rows, 12, 0.2, 3)


def test_merge_waits_for_all_projections(spark):
    rows = [(1, 1, 5, False), (1, 1, 5, True), (2, 1, 5, True), (3, 1, 5, False), (3, 1, 5, False)]
    df = spark.createDataFrame(rows, "seq int, id int, obj_id int, is_outlier boolean")
    assert {(r.seq, r.is_outlier) for r in O.outlier_merge(df, 2).collect()} == {(1, True), (3, False)}
