"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has bit i set if over half of the shingle hashes have it set.
Fingerprints link at ``RADIUS`` or fewer differing bits. Covering hashing (Pagh,
2016): position i gets a vector of RADIUS + 1 bits, and each of the
2^(RADIUS + 1) - 1 non-zero vectors v gives a mask of the positions whose vector
has an odd product with v. Any RADIUS positions span less than the whole space,
so some mask leaves all of them out: every pair within the radius meets in a
table, whatever its differing bits.

Copies collapse first: tables hold distinct fingerprints. A task reads its
buckets one after the other and links each bucket by searching outwards from one
member, which gives a tree and not all pairs. A bucket of more than ``BUCKET``
members goes on to finer tables: the positions outside its mask are cut into
RADIUS + 1 parts, one of which can't differ between linked members, so adding
each part to the mask in turn loses no link. With at most 12 positions left a
bucket has at most 4,096 different members, so this ends.

Null and empty texts have no words and the fingerprint zero, linked like any
other. Rows with equal id are told apart by nothing here: each row has its own
fingerprint. An id of null is never a component's smallest id; a component
without ids has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import with_columns
from .components import connected_components

RADIUS = 3
BUCKET = 4096
SEED = 42
SHINGLE = 3
_ROWS = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of the word shingles of a text, repeats included, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [h64(b" ".join(words), SEED)]
    else:
        parts = zip(*(words[i:] for i in range(size)))
        hashes = [h64(b" ".join(p), SEED) for p in parts]
    return print_of(np.array(hashes, "<u8"))


def print_of(h: np.ndarray) -> int:
    """Fingerprint of some shingle hashes: bit i is set if over half of them have it set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _ROWS):
        bits = np.unpackbits(h[at : at + _ROWS].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", size: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of each whole text as a signed long."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], "u8").view("i8"))

    return with_columns(df, **{out: run(F.col(text))})


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits, as signed longs."""
    vectors = range(1, 2 ** (radius + 1))
    of_position = [1 + i % len(vectors) for i in range(64)]
    masks = [sum(1 << i for i, p in enumerate(of_position) if (p & v).bit_count() % 2) for v in vectors]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with each of radius + 1 parts of its free positions added."""
    mask &= (1 << 64) - 1
    free = [i for i in range(64) if not mask >> i & 1]
    out = [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _tree(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join the members within the radius of each other, found outwards from one member."""
    rest = members
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                frontier.extend(found)
                yield from ((int(at), int(x)) for x in found)


def _buckets(parts: Iterator[pd.DataFrame], radius: int, most: int) -> Iterator[pd.DataFrame]:
    """Links of small buckets as (a, b, null), members of large ones as (null, fp, mask).

    The rows come sorted by mask and masked value. No more than one bucket of ``most`` members is held.
    """
    key, held, large = None, [], False

    def flush():
        if key is None or large or sum(map(len, held)) < 2:
            return None
        links = list(_tree(np.concatenate(held).view("u8"), radius))
        if not links:
            return None
        a, b = np.array(links, "u8").view("i8").reshape(-1, 2).T
        return pd.DataFrame({"a": a, "b": b, "mask": pd.array([None] * len(a), "Int64")})

    for part in parts:
        fp, mask, value = (part[c].to_numpy(np.int64) for c in ("fp", "mask", "value"))
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = [0, *cut.tolist(), len(fp)]
        for s, e in zip(bounds, bounds[1:]):
            if s == e:
                continue
            if key != (mask[s], value[s]):
                if held and (out := flush()) is not None:
                    yield out
                key, held, large = (mask[s], value[s]), [], False
            own = fp[s:e]
            if not large and sum(map(len, held)) + len(own) > most:
                own, held, large = np.concatenate([*held, own]), [], True
            if large:
                yield pd.DataFrame({"a": pd.array([None] * len(own), "Int64"), "b": own, "mask": pd.array([key[0]] * len(own), "Int64")})
            else:
                held.append(own)
    if held and (out := flush()) is not None:
        yield out


def links(prints: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within the radius of each other."""
    masks = F.explode(F.array(*[F.lit(m) for m in covering_masks(radius)]))
    rows = prints.select("fp", masks.alias("mask"))
    out = None
    while True:
        keyed = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).repartition("mask", "value").sortWithinPartitions("mask", "value")
        done = materialize(keyed.mapInPandas(lambda parts: _buckets(parts, radius, most), "a long, b long, mask long"))
        own = done.where("mask is null").select("a", "b")
        out = own if out is None else out.union(own)
        large = done.where("mask is not null")
        kept = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks: at most 15 x 4 per round
        if not kept:
            return out
        tables = F.create_map(*[x for m in kept for x in (F.lit(m), F.array(*[F.lit(f) for f in finer(m, radius)]))])
        rows = large.select(F.col("b").alias("fp"), F.explode(tables[F.col("mask")]).alias("mask"))


def classes(df: DataFrame, id_col: str = "doc_id", fp: str = "fp", radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint: the smallest id of its component."""
    by_print = materialize(df.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("low")))
    roots = connected_components(links(by_print.select("fp"), radius, most))
    joined = materialize(by_print.join(roots, by_print["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    best = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return joined.join(best, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``."""
    rows = materialize(fingerprints(df.select(id_col, text), text).select(id_col, "fp"))
    return rows.join(classes(rows, id_col, "fp", radius, most), "fp").select(id_col, "fp", "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Keep one document of each component: the smallest id (nulls last), ties by text hash."""
    rows = materialize(fingerprints(df.select(id_col, text), text).select(F.col(id_col).alias("id"), "fp", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")))
    # The smallest (id, text) of each fingerprint, then of each component.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("th")))
    by_print = materialize(rows.groupBy("fp").agg(first.alias("first")))
    roots = connected_components(links(by_print.select("fp"), radius, most))
    keep = (
        by_print.join(roots, by_print["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("k"))
        .select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"))
    )
    keyed = with_columns(df, __key=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = keyed.join(keep, keyed[id_col].eqNullSafe(keep["__id"]) & (keyed["__key"] == keep["__th"]), "left_semi")
    return kept.dropDuplicates([id_col, "__key"]).drop("__key")
