"""Connected components of a link table, by rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = materialize, drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``links`` (a, b) of longs to (node, root): the smallest node that can be reached.

    Every round links each node's larger neighbours, then its smaller ones, to the
    smallest node it knows (Kiveris et al., 2014). The links of a round are written to
    the checkpoint folder, nodes and links stay in Spark. Nodes without a link to
    another node are not returned; nulls are ignored. ``keep`` writes the links of a
    round, ``drop`` removes those of the round before.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = keep(edges)
    before = None
    while True:
        # Large star: larger neighbours of u go to the smallest node known to u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and u itself go to the smallest neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, keep(small.where("u <> v").distinct())
        if drop is not None:
            drop(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
