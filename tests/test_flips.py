"""The log of flips, replayed, gives the flags of all objects at every arrival."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weir.operators import flips as X
from weir.streaming import outliers as SO

from .test_streaming import put, stream

SCHEMA = "seq bigint, id bigint, projection_id int, projection_value double"


def walk(seed, n, objects, spots=None):
    rnd = random.Random(seed)
    return [(s, rnd.randrange(objects), p, (rnd.choice(spots) if spots else rnd.random()) + p) for s in range(n) for p in (0, 1)]


def replay(rows, distance, least):
    """Flags after every arrival, by the definition: x lies in [w - distance, w + distance], which rounds unlike |x - w|."""
    at, flags, log = {}, {}, []
    for s, i, p, v in sorted(rows, key=lambda r: (r[0], r[2])):
        at[p, i] = v
        for (q, j), w in at.items():
            if q == p:
                n = sum(1 for (r, k), x in at.items() if r == p and k != j and w - distance <= x <= w + distance)
                if flags.get((p, j)) != (n < least):
                    flags[p, j] = n < least
                    log.append((s, p, j, n, n < least))
    return log


@pytest.mark.parametrize("case", [(1, 60, 9, None, 0.2, 3), (2, 50, 6, [0.0, 0.1, 0.1, 0.3, 0.5], 0.1, 2), (2, 50, 6, [0.0, 0.125, 0.125, 0.375, 0.5], 0.125, 2), (3, 40, 40, None, 0.05, 1)])
def test_flips_equal_the_definition(spark, case):
    seed, n, objects, spots, distance, least = case
    rows = walk(seed, n, objects, spots)
    got = X.outlier_flips(spark.createDataFrame(rows, SCHEMA), distance, least)
    assert sorted(map(tuple, got.collect())) == sorted(replay(rows, distance, least))


def test_no_arrivals_and_one(spark):
    assert X.outlier_flips(spark.createDataFrame([], SCHEMA), 0.1, 2).count() == 0
    got = X.outlier_flips(spark.createDataFrame([(5, 1, 0, 0.5)], SCHEMA), 0.1, 2).collect()
    assert [tuple(r) for r in got] == [(5, 0, 1, 0, True)]


def test_stream_keeps_its_state(spark, tmp_path):
    """Batches of a stream with a restart give the log of the whole table; a quiet region is not read."""
    rows = walk(4, 60, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    queue, state, looked = tmp_path / "q", str(tmp_path / "s"), {}
    for lo in (0, 20):
        put(df.where(f"seq >= {lo} and seq < {lo + 20}"), queue)
    SO.flips(stream(spark, queue, 1), 0.2, 3, state, looked.__setitem__)
    put(df.where("seq >= 40"), queue)
    log = SO.flips(stream(spark, queue, 1), 0.2, 3, state, looked.__setitem__)
    assert sorted(map(tuple, log.drop("batch_id").collect())) == sorted(replay(rows, 0.2, 3))
    # Far away objects do not count as work.
    far = spark.createDataFrame([(100 + k, 500 + k, 0, 1000.0 + k) for k in range(50)], SCHEMA)
    put(far, queue)
    time.sleep(0.1)
    put(spark.createDataFrame([(200, 3, 0, 0.5)], SCHEMA), queue)
    SO.flips(stream(spark, queue, 1), 0.2, 3, state, looked.__setitem__)
    assert looked[3] == 0 and looked[4] <= 10


def test_since_complete(spark):
    rows = walk(6, 40, 5)
    log = X.outlier_flips(spark.createDataFrame(rows, SCHEMA), 0.2, 2)
    got = sorted(map(tuple, X.since_complete(log).collect()))
    want = []
    for p in (0, 1):
        own = [r for r in replay(rows, 0.2, 2) if r[1] == p]
        full = max(min(r[0] for r in own if r[2] == j) for j in range(5))
        last = {r[2]: r[4] for r in own if r[0] <= full}
        want += [(full, p, j, f) for j, f in last.items()] + [(r[0], p, r[2], r[4]) for r in own if r[0] > full]
    assert got == sorted(want)


@pytest.mark.parametrize("case", [(7, 90, 12, None, 0.2, 3), (8, 90, 9, [0.0, 0.1, 0.1, 0.3, 0.5], 0.1, 2), (9, 60, 30, None, 0.3, 5)])
def test_short_blocks_equal_the_definition(spark, case):
    """Blocks of two arrivals: stays are cut, settled and counted over the tree."""
    seed, n, objects, spots, distance, least = case
    rows = walk(seed, n, objects, spots)
    got = X.outlier_flips(spark.createDataFrame(rows, SCHEMA), distance, least, leaf=2)
    assert sorted(map(tuple, got.collect())) == sorted(replay(rows, distance, least))


def test_crowds_form_no_pairs(spark, monkeypatch):
    """Of many objects in one window only the first arrivals are looked at move by move."""
    rows = [(s, s % 100, 0, (s * 37 % 101) / 1000) for s in range(500)]
    seen = []
    whole = X.open_pieces

    def counting(*args):
        found, size = whole(*args)
        seen.append((found.count(), size))
        return found, size

    monkeypatch.setattr(X, "open_pieces", counting)
    got = X.outlier_flips(spark.createDataFrame(rows, SCHEMA), 0.2, 3, leaf=4)
    assert sorted(map(tuple, got.collect())) == sorted(replay(rows, 0.2, 3))
    assert seen[0][0] <= 16 and seen[0][1] == 4
