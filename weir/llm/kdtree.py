"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt into shards by hash of their id. A shard's tree splits at the
median of its widest dimension; each node keeps the tight bounding box of its
vectors. For a query q the inner product with any vector of a box is at most
sum(max(q_i * low_i, q_i * high_i)), so nodes are visited best bound first until
no bound reaches the kth score found so far.

Two passes: each query first searches the shard it lies in, and the kth score it
finds there travels with it to the other shards, where a whole shard is passed
over if its root's bound lies below that score. Queries and shards meet in blocks
of bounded size: a task holds one shard and reads its query blocks one by one.
A shard gives at most k candidates a query, the best k of all shards are ranked
by score, then by smaller id.

Arithmetic is exact: values are whole numbers, products are summed in doubles
where no sum can exceed 2^53 and in Python integers otherwise. Vectors that are
null, empty or hold a null, NaN or infinity take no part; a query meets vectors
of its own length only. A null id takes no part. Rows that repeat an id stand
for themselves, but none is a candidate of a query with its id. Without queries
or candidates the result is empty.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

K = 5
LEAF = 128
SHARD_ROWS = 8192
QUERY_ROWS = 1024


class Tree:
    """KD-tree over whole-number vectors; equal vectors share a leaf, however many they are."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.low, self.high, self.child, self.rows = [], [], [], []
        self._grow(np.arange(len(ids)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        todo, root = [(rows, -1, 0)], len(self.child)
        while todo:
            rows, parent, side = todo.pop()
            me, own = len(self.child), self.x[rows]
            lo, hi = own.min(0), own.max(0)
            self.low.append(lo)
            self.high.append(hi)
            self.child.append([-1, -1])
            self.rows.append(None)
            if parent >= 0:
                self.child[parent][side] = me
            d = int(np.argmax(hi - lo))
            if len(rows) <= leaf or hi[d] == lo[d]:
                self.rows[me] = np.sort(rows)
                continue
            column = own[:, d]
            left = column <= np.partition(column, len(column) // 2)[len(column) // 2]
            if left.all():  # the median is the largest value
                left = column < column.max()
            todo += [(rows[left], me, 0), (rows[~left], me, 1)]
        return root

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of queries (rows) with the vectors of every node."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, own_id: int, bounds: np.ndarray, k: int, least) -> list[tuple]:
        """The k best (score, -id) of at least ``least``, best first."""
        best: list[tuple] = []  # a heap, worst first
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < least or (len(best) == k and -bound < best[0][0]):
                break
            rows = self.rows[node]
            if rows is None:
                for c in self.child[node]:
                    heapq.heappush(todo, (-bounds[c], c))
                continue
            scores = self.x[rows] @ q
            worth = scores >= max(least, best[0][0]) if len(best) == k else scores >= least
            found = rows[worth]
            if len(found) > 4 * k:  # rows are in order of ids, so a stable sort keeps smaller ids first
                found = found[np.argsort(-scores[worth], kind="stable")[: 2 * k + np.count_nonzero(self.ids[found] == own_id)]]
            for r in found:
                if self.ids[r] == own_id:
                    continue
                item = (self.x[r] @ q, -int(self.ids[r]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)


def _matrix(vectors) -> np.ndarray:
    """Doubles if every inner product is exact in them, else Python integers."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    if x.size and float(np.abs(x).max()) ** 2 * x.shape[1] >= 2**53:
        return np.array([[int(c) for c in row] for row in x.tolist()], object)
    return x


def whole_vectors(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, x, dim, is_query): floor(scale * component) of the vectors that take part."""
    v = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(good)
    # floor() of a double gives a long; doubles beyond its range are whole already.
    big = lambda c: F.abs(c * scale) >= float(2**62)
    whole = F.transform(v, lambda c: F.when(big(c), c * scale).otherwise(F.floor(F.when(big(c), 0.0).otherwise(c * scale)).cast("double")))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"), F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"))


def _searched(tree: Tree, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries):
        q = _matrix(queries["x"])
        bounds = tree.bounds(q)
        for i, (own, kth) in enumerate(zip(queries["vec_id"], queries["kth"])):
            found = tree.search(q[i], own, bounds[i], k, -math.inf if pd.isna(kth) else kth)
            out += [(own, -n, max(-(2**63), min(2**63 - 1, int(s)))) for s, n in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


SCHEMA = "query_id long, vec_id long, score long"


def top_k(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every row for which ``is_query`` holds."""
    # A row that repeats id and vector is the same candidate.
    rows = materialize(whole_vectors(df, is_query, id_col, vector, scale).dropDuplicates(["vec_id", "x"]))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).first()
    shards, blocks = max(1, math.ceil(count["n"] / shard_rows)), max(1, math.ceil((count["q"] or 0) / query_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int"))
    part = F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), F.lit(blocks)).cast("int")

    def home(group: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(group["vec_id"].to_numpy(), _matrix(group["x"]))
        return _searched(tree, group[group["is_query"]].assign(kth=float("nan")), k)

    near = materialize(rows.groupBy("shard", "dim").applyInPandas(home, SCHEMA))
    if shards == 1:
        return ranked(near, k)
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("low"))
    queries = rows.where("is_query").join(kth, F.col("vec_id") == F.col("query_id"), "left")
    sent = queries.select(
        "vec_id", "x", "dim", F.when(F.col("found") >= k, F.col("low").cast("double")).alias("kth"),
        part.alias("block"), F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    ).where("shard <> home")
    # A task gets one shard and one block of queries.
    members = rows.select("vec_id", "x", "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def away(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or asked.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        tree = Tree(vectors["vec_id"].to_numpy(), _matrix(vectors["x"]))
        return _searched(tree, asked.rename(columns={"q_id": "vec_id", "q": "x"}), k)

    key = ["shard", "block", "dim"]
    sent = sent.select(*[F.col(c).alias(f"to_{c}") for c in key], F.col("vec_id").alias("q_id"), F.col("x").alias("q"), "kth")
    far = members.groupBy(*key).cogroup(sent.groupBy(*[f"to_{c}" for c in key])).applyInPandas(away, SCHEMA)
    return ranked(near.union(far), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of the candidates of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
