"""Near-duplicates by the Jaccard similarity of word shingles, for the pipeline.

Two documents link if their sets of ``SHINGLE``-word shingles have a Jaccard
similarity of ``LEAST`` or more, counted on 32-bit shingle hashes. Documents
with equal sets (64-bit hashes) collapse first. Candidates come from MinHash: ``BANDS`` bands of
``ROWS`` minima each; a pair of similarity s meets in some band with probability
1 - (1 - s^ROWS)^BANDS: 99.93 % at 0.8, 99.9999 % at 0.9. SimHash, as in ``op9_simhash`` but over
the set of these shingles, gives one band more: its value is the component of fingerprints that link at
``simhash.RADIUS`` or fewer differing bits, found with covering masks. Every pair that meets in a band is settled.

No bucket is paired off in full. In each of ``ROUNDS`` rounds a bucket's members are
compared with one of them, the hub, unless they are in its component already; then the
hub leaves the bucket, all its pairs being settled. A bucket whose members are all
in one component is done: groups of copies end here, whatever their size.

Buckets that still hold several components are those of documents alike in
part, such as pages of one template. All their sets are compared by prefixes: with the
shingles of every set ordered by the number of sets that hold them, two alike sets
x and y (the larger and the smaller) have their first common shingle among the
|x| - ceil(t |x|) + 1 rarest of x and the |y| - ceil(2 t / (1 + t) |y|) + 1 rarest of y, at
places that leave enough shingles behind them. Shared template text is frequent and
comes last, so it makes no candidates. A shingle that is the first of more than
``WIDE`` sets y is taken together with the second common one, which lies
one place deeper at most. Nothing is capped: the prefix bound is exact.

Null and empty texts have the empty set and link to each other. A text of fewer
words than a shingle has one shingle of all its words. Of rows that repeat id and text
the first in the order of their JSON form stays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import broadcast_if_small
from . import simhash
from .common import discard, join_counted, release, stored, text_key, with_columns
from .components import connected_components

SHINGLE = 5
LEAST = (4, 5)
BANDS, ROWS = 24, 6
ROUNDS = 3
WIDE = 64
SEED = 42
_STEP = 1 << 12
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), "u8")
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "<u8")
    parts = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], "<u8"))


def signature(own: np.ndarray) -> tuple[int, list[int]]:
    """Hash of a set and one hash per band, as signed longs; no bands for the empty set."""
    import xxhash

    name = np.array(xxhash.xxh64_intdigest(own.tobytes(), SEED), "u8").view("i8").item()
    if not len(own):
        return name, []
    low = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for at in range(0, len(own), _STEP):
        low = np.minimum(low, ((own[at : at + _STEP, None] ^ _XOR) * _TIMES).min(0))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.astype("<u8").reshape(BANDS, ROWS))]
    return name, np.array(bands, "u8").view("i8").tolist()


@F.pandas_udf(T.StructType([T.StructField("sh", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]))
def _signatures(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    prints = np.array([simhash.print_of(own) for own in sets], "u8").view("i8")
    return pd.DataFrame([(*signature(own), fp) for own, fp in zip(sets, prints.tolist())], columns=["sh", "bands", "fp"])


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingles(t).astype("<u4")).tobytes() for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _tokens(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view("<i8") for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ra, rb) whose sets (sh, own) are alike, as (ra, rb). Sets of hot ``a`` are broadcast."""
    hubs = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(sets.select(F.col("sh").alias("a"), F.col("own").alias("own_a")), "a"))
    # Sets of very different sizes can't be alike and aren't compared.
    size_a, size_b = F.octet_length("own_a"), F.octet_length("own_b")
    fits = (F.least(size_a, size_b) * LEAST[1] >= F.greatest(size_a, size_b) * LEAST[0])
    both = join_counted(pairs, hubs, ["a"]).join(sets.select(F.col("sh").alias("b"), F.col("own").alias("own_b")), "b").where(fits)
    found = stored(both.where(_alike("own_a", "own_b")).select("ra", "rb").distinct())
    discard(pairs.sparkSession, hubs)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the links (ra, rb); nothing of its rounds stays on disk but the result."""
    spark = links.sparkSession
    return connected_components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), stored, lambda old: discard(spark, old))


def _enough(size_y: str, size_x: str, left_y: Column, left_x: Column) -> Column:
    """Whether the shingles left in both sets suffice for an overlap of t / (1 + t) of both sizes."""
    t, of = LEAST
    return (t + of) * F.least(left_y, left_x) >= t * (F.col(size_y) + F.col(size_x))


def _meet(entries: DataFrame, keys: list[str], ahead: int) -> DataFrame:
    """Pairs (a, b, ra, rb) of alike enough size that share a key: a as the smaller set, by its shorter prefix.

    ``ahead`` common shingles come before the place ``at`` of the key.
    """
    y = entries.where("short").select(*keys, *[F.col(c).alias(f"{c}_y") for c in ("sh", "root", "size", "at")])
    x = entries.select(*keys, *[F.col(c).alias(f"{c}_x") for c in ("sh", "root", "size", "at")])
    fits = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    fits += [F.col("root_x") != F.col("root_y"), F.struct("size_y", "sh_y") < F.struct("size_x", "sh_x")]
    fits += [LEAST[1] * F.col("size_y") >= LEAST[0] * F.col("size_x")]
    fits += [_enough("size_y", "size_x", F.col("size_y") - F.col("at_y") + ahead, F.col("size_x") - F.col("at_x") + ahead)]
    return y.alias("y").join(x.alias("x"), fits).select(F.col("sh_y").alias("a"), F.col("sh_x").alias("b"), F.col("root_y").alias("ra"), F.col("root_x").alias("rb"))


def prefix_pairs(tokens: DataFrame, roots: DataFrame, wide: int = WIDE) -> DataFrame:
    """Pairs (a, b, ra, rb) of sets in different components that can be alike; none that are alike is missing.

    ``tokens`` is (sh, size, w), a row per shingle of a set, ``roots`` (sh, root).
    """
    t, of = LEAST
    spark = tokens.sparkSession
    held = stored(tokens.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    ranked = join_counted(tokens, held, ["w"]).groupBy("sh").agg(F.first("size").cast("long").alias("size"), F.sort_array(F.collect_set(F.struct("n", "w"))).alias("own"))
    # Shingles of one set alone come first in the order; they take places, but no entries.
    alone = F.col("size") - F.size("own")
    long = F.expr(f"size - (size * {t} + {of - 1}) div {of} + 1")
    short = F.expr(f"size - (size * {2 * t} + {t + of - 1}) div {t + of} + 1")
    # One place more than the prefix: second common shingles can lie there.
    room = F.greatest(F.lit(0), long + 1 - alone).cast("int")
    entries = ranked.select("sh", "size", long.alias("long"), short.alias("short_to"), alone.alias("alone"), F.posexplode(F.slice("own", 1, room)).alias("p", "e"))
    entries = entries.select("sh", "size", "long", "short_to", (F.col("p") + F.col("alone")).alias("at"), F.col("e.w").alias("w"))
    deep = stored(entries.join(roots, "sh").withColumn("short", F.col("at") < F.col("short_to")))
    entries = deep.where(F.col("at") < F.col("long"))
    shared = entries.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("firsts"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = stored(shared.where("n > 1 and firsts > 0 and lo <> hi").select("w", "n", "firsts"))
    usable = stored(join_counted(entries, shared, ["w"]).select(*entries.columns, (F.col("firsts") > wide).alias("hot")))
    once = _meet(usable.where("not hot"), ["w"], 0)
    second = deep.select("sh", F.col("at").alias("at2"), F.col("w").alias("w2"))
    both = usable.where("hot").join(second, "sh").where("at2 > at")
    both = both.select("sh", "root", "size", "w", "w2", F.col("at2").alias("at"), (F.col("short") & (F.col("at2") < F.col("short_to") + 1)).alias("short"))
    pairs = stored(once.unionByName(_meet(both, ["w", "w2"], 1)).distinct())
    discard(spark, held, deep, shared, usable)
    return pairs


def with_print_band(by_set: DataFrame) -> DataFrame:
    """Sets (sh, bands, fp) with the component of their fingerprint as a band more; the empty set has none."""
    prints = stored(by_set.where(F.size("bands") > 0).select("fp").distinct())
    roots = connected_components(simhash.links(prints))
    linked = by_set.join(roots, F.col("fp") == F.col("node"), "left")
    own = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    done = stored(linked.select("sh", F.when(F.size("bands") > 0, F.array_append("bands", own)).otherwise(F.col("bands")).alias("bands")))
    discard(by_set.sparkSession, prints)
    return done


def links(by_set: DataFrame, sets_of, tokens_of, rounds: int = ROUNDS) -> DataFrame | None:
    """(node, root) of the sets ``sh`` that link to others; None if no bucket has two members.

    ``sets_of`` takes the distinct ``sh`` that share a bucket and returns (sh, own),
    ``tokens_of`` those of crowded buckets and returns (sh, size, w).
    """
    live = by_set.select("sh", F.explode("bands").alias("key")).withColumn("root", F.col("sh"))
    spark = by_set.sparkSession
    found, sets = [], None
    for turn in range(rounds + 1):
        # The first hub is the smallest member, so that the buckets of a group share it; later ones differ.
        order = F.col("sh") if turn == 0 else F.xxhash64("sh", "key")
        counted = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("sh", "root"), order).alias("hub"))
        counted = stored(counted.where("lo <> hi").select("key", "n", "hub"))
        rest = stored(join_counted(live, counted, ["key"]).where(F.col("sh") != F.col("hub.sh")).select("sh", "key", "root", "hub"))
        if turn < rounds:
            pairs = rest.where(F.col("root") != F.col("hub.root")).select(F.col("hub.sh").alias("a"), F.col("sh").alias("b"), F.col("hub.root").alias("ra"), F.col("root").alias("rb"))
            pairs = stored(pairs.distinct())
        else:
            crowd = rest.select("sh", "root").union(rest.select("hub.sh", "hub.root")).distinct()
            crowd = stored(crowd)
            tokens = stored(tokens_of(crowd.select("sh")))
            pairs = prefix_pairs(tokens, crowd)
            discard(spark, tokens, crowd)
        if pairs.isEmpty():
            discard(spark, counted, rest, pairs, live if turn else None)
            break
        if sets is None:
            sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sh")).distinct())
        new = verified(pairs, sets)
        found.append(new)
        before = live if turn else None
        if turn < rounds:
            roots = components(new).withColumnRenamed("root", "now")
            live = stored(rest.select("sh", "key", "root").join(roots, F.col("root") == F.col("node"), "left").select("sh", "key", F.coalesce("now", "root").alias("root")))
            discard(spark, roots)
            del roots
        discard(spark, counted, rest, pairs, before)
        del counted, rest, pairs, before, new
        release(spark)
    discard(spark, sets)
    if not found:
        return None
    # Links of later rounds join the roots of earlier ones.
    return components(reduce(DataFrame.union, found))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Keep one document of each component: the smallest id (nulls last), ties by text hash."""
    spark = df.sparkSession
    release(spark)
    rows = df.select(F.col(id_col).alias("id"), text_key(text).alias("th"), _signatures(F.col(text)).alias("s"))
    rows = stored(rows.select("id", "th", "s.sh", "s.bands", "s.fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("th")))
    by_set = rows.groupBy("sh").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    by_set = stored(by_set)

    def named(which: DataFrame, how: str = "inner") -> DataFrame:
        """Rows of df that ``which`` (__id, __th, ...) names, texts unmoved while that list is small."""
        keyed = with_columns(df, __key=text_key(text))
        return keyed.join(broadcast_if_small(which), keyed[id_col].eqNullSafe(which["__id"]) & (keyed["__key"] == which["__th"]), how)

    def texts_of(shared: DataFrame) -> DataFrame:
        which = stored(by_set.select("sh", "first").join(shared, "sh").select(F.col("first.id").alias("__id"), F.col("first.th").alias("__th"), F.col("sh").alias("__sh")))
        return named(which).select(F.col("__sh").alias("sh"), F.col(text).alias("t"))

    def sets_of(shared: DataFrame) -> DataFrame:
        packed = texts_of(shared).select("sh", _packed("t").alias("own"))
        return stored(packed.groupBy("sh").agg(F.first("own").alias("own")))

    def tokens_of(shared: DataFrame) -> DataFrame:
        cut = texts_of(shared).select("sh", _tokens("t").alias("own"))
        return cut.select("sh", F.size("own").alias("size"), F.explode("own").alias("w"))

    banded = with_print_band(by_set)
    roots = links(banded, sets_of, tokens_of, rounds)
    grouped = by_set.select("sh", "first", "n")
    if roots is not None:
        grouped = grouped.join(roots, F.col("sh") == F.col("node"), "left").select("sh", "first", "n", F.coalesce("root", "sh").alias("root"))
    else:
        grouped = grouped.withColumn("root", F.col("sh"))
    best = grouped.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    # Only sets of components with several rows can lose one.
    best = stored(grouped.select("sh", "root", F.col("n").alias("n")).join(best, "root").select("sh", "n", "first"))
    members = stored(join_counted(rows.select("id", "th", "sh"), best, ["sh"]).select(F.col("id").alias("__id"), F.col("th").alias("__th"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))).alias("stays")))
    gone = members.where("not stays").select("__id", "__th").distinct()
    twice = members.where("stays").groupBy("__id", "__th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone, twice = stored(gone), stored(twice)
    left = named(gone.unionByName(twice), "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    again = named(twice).groupBy("__id", "__th").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("row"))
    discard(spark, rows, by_set, banded, best, members)
    return left.unionByName(again.select("row.*"))
