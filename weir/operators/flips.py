"""Outlier flags of moving objects as a log of the flags that flip.

An object is an outlier of a projection if fewer than ``min_neighbors`` other objects lie
within ``distance`` of it. An arrival moves one object; only objects near its old or its
new place can change, so arrivals meet the objects of the cells around those
two places and no others. What an object was and becomes between two of its own
arrivals is a stay; a stay's count is its count at the start plus the running sum
of the moves into and out of its window.

Stays that no run of moves can carry over the limit are settled without looking at
single moves: the moves into and out of each window are counted first, from running
sums over values. Objects of equal value that do not move share one stay.

All other stays are cut into blocks of arrivals. A piece is settled if the objects that rest
in its window all through the block are enough; open pieces are cut into shorter
blocks, and only those left open at ``LEAF`` arrivals meet the moves near them. The count
at any arrival is a sum over the nodes of a binary tree of arrivals, a window sum each. So
work grows with arrivals x log(arrivals), also where everything is near everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import Lag, RunningSum, dense_int_index, ordered_scan, range_scan
from ..session import materialize

# Cells are a little wider than the distance, so that rounding never puts neighbours two cells apart.
MARGIN = 1 + 1e-6
WIDTH = 4096
# Arrivals within which moves are looked at in pairs.
LEAF = 512
START = -(1 << 62)
KEYS = ["projection_id", "obj_id"]


def cell(value: Column, distance: float) -> Column:
    return F.floor(value / F.lit(distance * MARGIN))


def around(value: Column, distance: float) -> Column:
    """The cell of a value and its two neighbours."""
    c = cell(value, distance)
    return F.array(c - 1, c, c + 1)


def near_to(value: Column, x: Column, distance: float) -> Column:
    """The same two comparisons as the window sums make, so that rounding cannot part the two."""
    return (x >= value - distance) & (x <= value + distance)


def moves(arrivals: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(seq, projection_id, obj_id, old, new, until): each arrival with the object's place before it and its next arrival.

    ``places`` (projection_id, obj_id, value) knows where objects were before the first of these arrivals.
    """
    rows = materialize(arrivals.select("seq", "projection_id", F.col("id").alias("obj_id"), F.col("projection_value").alias("new")))
    back = ordered_scan(rows, KEYS, ["seq"], [Lag("old", "new")], WIDTH)
    ahead = rows.select(*KEYS, "seq", (-F.col("seq")).alias("__back"))
    ahead = ordered_scan(ahead, KEYS, ["__back"], [Lag("until", "seq")], WIDTH).select(*KEYS, "seq", "until")
    out = back.join(ahead, [*KEYS, "seq"])
    if places is not None:
        out = out.join(places.select(*KEYS, F.col("value").alias("__was")), KEYS, "left").withColumn("old", F.coalesce("old", "__was")).drop("__was")
    return materialize(out)


def events_of(moved: DataFrame) -> DataFrame:
    """(projection_id, seq, mover, rank, odd, x, w): +1 where a move ends, -1 where it starts."""
    ends = F.array(F.struct(F.col("new").alias("x"), F.lit(1).alias("w")), F.struct(F.col("old").alias("x"), F.lit(-1).alias("w")))
    rows = moved.select("projection_id", "seq", F.col("obj_id").alias("mover"), "rank", "odd", F.explode(ends).alias("e"))
    return rows.select("projection_id", "seq", "mover", "rank", "odd", "e.x", "e.w").where("x is not null")


def window_sums(asked: DataFrame, points: DataFrame, distance: float, sums: list[str], group: Sequence[str] = ("projection_id",)) -> DataFrame:
    """(group, value, sums): weights of the group's points within ``distance`` of each distinct value asked for; no pairs."""
    keys = [*group, "value"]
    v = F.col("value")
    none = [F.lit(0).cast("bigint").alias(s) for s in sums]
    # kind 0: question below, before equal points; 1: points; 2: question above.
    marks = F.array(F.struct((v - distance).alias("x"), F.lit(0).alias("kind")), F.struct((v + distance).alias("x"), F.lit(2).alias("kind")))
    questions = asked.select(*keys).distinct().select(*keys, F.explode(marks).alias("m")).select(*keys, "m.x", "m.kind", *none)
    own = points.select(*group, F.lit(None).cast("double").alias("value"), "x", F.lit(1).alias("kind"), *sums)
    ranked = range_scan(questions.unionByName(own), group, ["x", "kind"], [RunningSum(f"__{s}", s) for s in sums])
    signed = lambda s: F.sum(F.when(F.col("kind") == 2, F.col(f"__{s}")).otherwise(-F.col(f"__{s}"))).alias(s)
    return ranked.where("kind <> 1").groupBy(*keys).agg(*[signed(s) for s in sums])


def sums_before(asked: DataFrame, events: DataFrame, distance: float, leaves: int, leaf: int) -> DataFrame:
    """(projection_id, value, at, w): weights of the events of a rank below ``at`` within ``distance`` of ``value``.

    Ranks fall into ``leaves`` leaves of ``leaf`` ranks under a binary tree. An earlier leaf lies left of a
    later one below exactly one node, so each level is a window sum by node; pairs form inside a leaf only.
    """
    p = "projection_id"
    asked = materialize(asked.select(p, "value", "at").where("value is not null").distinct())
    levels = max(1, (leaves + 1).bit_length())
    own = F.expr(f"at div {leaf}")
    side = lambda place, bit: F.explode(F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.call_function("getbit", place, k) == bit))
    node = F.call_function("shiftright", F.col("__leaf"), F.col("level") + 1).alias("node")
    right = asked.withColumn("__leaf", own).withColumn("level", side(F.col("__leaf"), 1)).select(p, "level", node, "value", "at")
    left = events.withColumn("__leaf", F.expr(f"rank div {leaf}")).withColumn("level", side(F.col("__leaf"), 0)).select(p, "level", node, "x", "w")
    group = [p, "level", "node"]
    points = left.groupBy(*group, "x").agg(F.sum("w").alias("w"))
    earlier = right.join(window_sums(right, points, distance, ["w"], group), [*group, "value"]).select(p, "value", "at", "w")
    inside = asked.withColumn("__leaf", own).withColumn("cell", F.explode(around(F.col("value"), distance)))
    near = inside.join(events.select(p, F.expr(f"rank div {leaf}").alias("__leaf"), cell(F.col("x"), distance).alias("cell"), "rank", "x", "w"), [p, "__leaf", "cell"])
    near = near.where((F.col("rank") < F.col("at")) & near_to(F.col("value"), F.col("x"), distance)).select(p, "value", "at", "w")
    zero = asked.select(p, "value", "at", F.lit(0).cast("bigint").alias("w"))
    return zero.unionByName(earlier).unionByName(near).groupBy(p, "value", "at").agg(F.sum("w").alias("w"))


def pieces_of(stays: DataFrame, size: int) -> DataFrame:
    """The stays from rank ``lo`` up to ``hi``, cut at the borders of blocks of ``size`` ranks."""
    low, high = F.greatest(F.col("lo"), F.lit(0)), F.greatest(F.col("hi") - 1, F.col("lo"), F.lit(0))
    return stays.withColumn("block", F.explode(F.sequence(low - F.pmod(low, F.lit(size)), high, F.lit(size).cast("bigint")))).withColumn("block", F.expr(f"block div {size}"))


def clip(pieces: DataFrame, size: int) -> DataFrame:
    """``lo`` and ``hi`` of each piece within its block."""
    low, high = F.col("block") * size, (F.col("block") + 1) * size
    return pieces.withColumn("lo", F.greatest(F.col("lo"), low)).withColumn("hi", F.least(F.col("hi"), high)).drop("block")


def open_pieces(stays: DataFrame, lost: DataFrame, distance: float, min_neighbors: int, size: int, leaf: int) -> tuple[DataFrame, int]:
    """The pieces of stays in which the limit may be passed, and the size of their blocks.

    A piece is settled if enough others rest in its window all through its block. What is left open
    is cut into shorter blocks, through which more of the others rest. ``lost`` (projection_id, value, lost) is what
    repeated arrivals may take from a count. ``size`` is ``leaf`` times a power of 2.
    """
    group = ["projection_id", "block"]
    asks, rests = stays.where("asks").drop("n", "asks"), stays.select("projection_id", "value", "s", "lo", "hi", "n")
    while True:
        cut = pieces_of(rests, size)
        # There before the block's first move, so that no flip falls between two settled pieces.
        full = cut.where((F.col("s") < F.col("block") * size) & (F.col("hi") >= (F.col("block") + 1) * size))
        full = full.groupBy(*group, F.col("value").alias("x")).agg(F.sum("n").alias("rest"))
        asked = pieces_of(asks, size)
        resting = window_sums(asked, full, distance, ["rest"], group)
        least = asked.join(resting, [*group, "value"]).join(lost, ["projection_id", "value"], "left")
        # The piece itself may be one of those that rest.
        found = materialize(least.where(F.col("rest") - 1 - F.coalesce("lost", F.lit(0)) < min_neighbors).drop("rest", "lost"))
        if size <= leaf or found.isEmpty():
            return found, size
        cells = found.select(*group, F.explode(around(F.col("value"), distance)).alias("cell")).distinct()
        near = cut.withColumn("cell", cell(F.col("value"), distance)).join(cells, [*group, "cell"], "left_semi")
        rests = materialize(clip(near.drop("cell"), size))
        asks = clip(found, size)
        size = max(leaf, size // 16)


def paired(stays: DataFrame, events: DataFrame, distance: float) -> DataFrame:
    """(projection_id, value, obj_id, since, seq, w): first count of each stay, then the moves near it, one by one."""
    p = "projection_id"
    at = stays.withColumn("cell", F.explode(around(F.col("value"), distance)))
    near = at.join(events.withColumn("cell", cell(F.col("x"), distance)), [p, "cell"])
    inside = near_to(F.col("value"), F.col("x"), distance) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))) & (F.col("obj_id") != F.col("mover"))
    key = [p, "value", "obj_id", "since"]
    # What happened up to the stay's start is part of its first count.
    steps = near.where(inside).groupBy(*key, F.greatest("seq", "since").alias("seq")).agg(F.sum("w").alias("w")).where("w <> 0")
    return steps.unionByName(stays.select(*key, F.col("since").alias("seq"), F.col("n0").alias("w"))).groupBy(*key, "seq").agg(F.sum("w").alias("w"))


def advance(known: DataFrame, moved: DataFrame, distance: float, min_neighbors: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(log, after) of the moves, given the objects around them.

    ``known`` (projection_id, obj_id, value, neighbors) holds at least all objects whose
    cell is around an old or a new place. ``log`` has (seq, projection_id, obj_id,
    neighbors, is_outlier) for each flag that differs from the object's flag before,
    the first one included. ``after`` has the same columns as ``known``.
    """
    p, zero = "projection_id", F.lit(0).cast("bigint")
    ranks = materialize(dense_int_index(moved.select("seq").distinct(), "seq", "rank"))
    count = ranks.count()
    # Arrivals that repeat a number of their object have no order; their objects are counted move by move.
    odd = materialize(moved.groupBy(*KEYS, "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS).distinct().withColumn("odd", F.lit(True)))
    ends = ranks.select(F.col("seq").alias("until"), F.col("rank").alias("u"))
    moved = moved.join(ranks, "seq").join(ends, "until", "left").join(odd, KEYS, "left")
    moved = materialize(moved.withColumn("odd", F.coalesce("odd", F.lit(False))))
    events = materialize(events_of(moved))
    # Per distinct value: objects before the moves, and moves into and out of its window over the whole batch.
    points = events.groupBy(p, "x").agg(F.sum(F.when(F.col("w") > 0, 1).otherwise(0)).alias("enter"), F.sum(F.when(F.col("w") < 0, 1).otherwise(0)).alias("leave"), F.sum(F.when(F.col("odd") & (F.col("w") < 0), 1).otherwise(0)).alias("lost"))
    there = known.groupBy(p, F.col("value").alias("x")).agg(F.count(F.lit(1)).alias("base"))
    points = points.withColumn("base", zero).unionByName(there.select("*", *[zero.alias(c) for c in ("enter", "leave", "lost")]))
    values = known.select(p, "value").unionByName(moved.select(p, F.col("new").alias("value")))
    touched = materialize(window_sums(values, points, distance, ["base", "enter", "leave", "lost"]))
    first = moved.groupBy(*KEYS).agg(F.min("seq").alias("until"), F.min("rank").alias("u"), F.max("odd").alias("odd"))
    old = known.join(touched, [p, "value"]).join(first, KEYS, "left")
    n = F.col("neighbors")
    # An object that stays put and cannot pass the limit whatever the order of the moves.
    safe = F.col("until").isNull() & F.when(n < min_neighbors, n + F.col("enter") < min_neighbors).otherwise(n - F.col("leave") >= min_neighbors)
    old = materialize(old.withColumn("safe", safe))
    resting_after = old.where("until is null").select(*KEYS, "value", (n + F.col("enter") - F.col("leave")).alias("neighbors"))

    # Stays of objects that were there before: movers one by one, the others once per value.
    none, end = F.lit(None).cast("bigint"), F.lit(count).cast("bigint")
    still = old.where("until is null").groupBy(p, "value").agg(F.max(F.when(~F.col("safe"), n)).alias("n0"), F.count(F.lit(1)).alias("n"), F.max(~F.col("safe")).alias("asks"))
    resting = still.select(p, "value", none.alias("obj_id"), F.lit(START).alias("since"), none.alias("until"), "n0", F.lit(-1).cast("bigint").alias("s"), end.alias("u"), F.lit(False).alias("odd"), "n", "asks")
    one, yes = F.lit(1).cast("bigint"), F.lit(True)
    going = old.where("until is not null").select(p, "value", "obj_id", F.lit(START).alias("since"), "until", n.alias("n0"), F.lit(-1).cast("bigint").alias("s"), "u", "odd", one.alias("n"), yes.alias("asks"))
    # Stays that begin with a move: who was in the window before the first move, less the object itself.
    new = moved.select(p, F.col("new").alias("value"), "obj_id", F.col("seq").alias("since"), "until", F.col("rank").alias("s"), F.coalesce("u", end).alias("u"), "odd").join(touched, [p, "value"])
    itself = known.select(*KEYS, F.col("value").alias("__own"))
    # An object's own moves leave one at its place and take the one before the first move away.
    self_near = F.when(F.col("odd"), F.coalesce(near_to(F.col("value"), F.col("__own"), distance), F.lit(False)).cast("bigint")).otherwise(1)
    coming = new.join(itself, KEYS, "left").select(p, "value", "obj_id", "since", "until", (F.col("base") - self_near).alias("n0"), "s", "u", "odd", one.alias("n"), yes.alias("asks"))
    stays = materialize(resting.unionByName(going).unionByName(coming))
    single = stays.where("not odd")

    # Stretches of the stays in which the limit may be passed, and the counts before them and after each arrival.
    objects = old.select(*KEYS).union(first.select(*KEYS)).distinct().groupBy(p).count().agg(F.max("count")).first()[0] or 0
    # Blocks of about half the arrivals that the objects need to move once.
    size = leaf
    while size * 4 <= objects:
        size *= 2
    lost = touched.where("lost > 0").select(p, "value", "lost")
    found, size = open_pieces(single.withColumn("lo", F.col("s")).withColumnRenamed("u", "hi").drop("until", "odd"), lost, distance, min_neighbors, size, leaf)
    found = materialize(found.withColumn("at", F.greatest(F.col("s") + 1, F.col("block") * size)).withColumn("stop", F.least(F.col("hi"), (F.col("block") + 1) * size)))
    arrived = single.where(F.col("since") > START).withColumn("at", F.col("s") + 1)
    asked = arrived.select(p, "value", "at").unionByName(found.select(p, "value", "at"))
    sums = materialize(sums_before(asked, events, distance, count // leaf + 1, leaf))
    counted = lambda rows: rows.join(sums, [p, "value", "at"]).withColumn("c", F.col("n0") + F.col("w")).drop("w")
    key = [p, "value", "obj_id", "since"]
    stretch = [*key, "block", "c"]
    at = counted(found).select(*stretch, "at", "stop", F.explode(around(F.col("value"), distance)).alias("cell"))
    near = at.join(events.select(p, "seq", "rank", "x", "w", F.expr(f"rank div {size}").alias("block"), cell(F.col("x"), distance).alias("cell")), [p, "block", "cell"])
    inside = (F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("stop")) & near_to(F.col("value"), F.col("x"), distance)
    steps = near.where(inside).groupBy(*stretch, "seq").agg(F.sum("w").alias("w")).where("w <> 0")
    running = lambda of: Window.partitionBy(*of).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = steps.withColumn("neighbors", F.col("c") + F.sum("w").over(running(stretch))).select(*key, "seq", "neighbors")
    before_all = single.where((F.col("since") == START) & F.col("asks")).select(*key, F.col("since").alias("seq"), F.col("n0").alias("neighbors"))
    after_move = counted(arrived).select(*key, F.col("since").alias("seq"), F.col("c").alias("neighbors"))
    by_move = paired(stays.where("odd"), events, distance)
    by_move = by_move.withColumn("neighbors", F.sum("w").over(running(key))).select(*key, "seq", "neighbors")
    counts = materialize(stepped.unionByName(before_all).unionByName(after_move).unionByName(by_move))

    # Back to objects: those that rest at a value share its counts.
    sharing = old.where("not safe and until is null").select(*KEYS, "value")
    shared = counts.where("obj_id is null").drop("obj_id").join(sharing, [p, "value"]).select(*KEYS, "value", "seq", "neighbors")
    line = materialize(shared.unionByName(counts.where("obj_id is not null").select(*KEYS, "value", "seq", "neighbors")))
    flag = F.col("neighbors") < min_neighbors
    before = F.lag(flag).over(Window.partitionBy(*KEYS).orderBy("seq"))
    log = line.withColumn("is_outlier", flag).withColumn("was", before).where((F.col("seq") > START) & (F.col("was").isNull() | (F.col("was") != F.col("is_outlier"))))
    last = line.join(odd, KEYS, "left_semi").groupBy(*KEYS).agg(F.max_by(F.struct("value", "neighbors"), "seq").alias("l")).select(*KEYS, "l.value", "l.neighbors")
    moved_to = moved.where("not odd and until is null").select(*KEYS, F.col("new").alias("value")).join(touched, [p, "value"])
    moved_to = moved_to.select(*KEYS, "value", (F.col("base") + F.col("enter") - F.col("leave") - 1).alias("neighbors"))
    untouched = known.join(touched, [p, "value"], "left_anti").join(first, KEYS, "left_anti").select(*KEYS, "value", "neighbors")
    after = resting_after.unionByName(last).unionByName(moved_to).unionByName(untouched)
    return log.select("seq", *KEYS, F.col("neighbors").cast("bigint").alias("neighbors"), "is_outlier"), after


def no_objects(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "projection_id int, obj_id bigint, value double, neighbors bigint")


def outlier_flips(projected: DataFrame, distance: float, min_neighbors: int, leaf: int = LEAF) -> DataFrame:
    """The log of all arrivals of a table (seq, id, projection_id, projection_value), from the first one on."""
    log, _ = advance(no_objects(projected), moves(projected), distance, min_neighbors, leaf)
    return log


def since_complete(log: DataFrame) -> DataFrame:
    """The log from the arrival on that made the last object known: flags of all objects then, flips after that.

    The first row of an object in the log is its first arrival.
    """
    full = log.groupBy(*KEYS).agg(F.min("seq").alias("seq")).groupBy("projection_id").agg(F.max("seq").alias("full"))
    rows = log.join(F.broadcast(full), "projection_id")
    until = rows.where("seq <= full").groupBy(*KEYS).agg(F.max("full").alias("full"), F.max_by(F.struct("neighbors", "is_outlier"), "seq").alias("l"))
    return until.select(F.col("full").alias("seq"), *KEYS, "l.is_outlier").unionByName(rows.where("seq > full").select("seq", *KEYS, "is_outlier"))
