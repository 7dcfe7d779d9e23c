"""Reducers against exact results, with a hot key; fan-out with a writer that fails."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators.reducers import Quantiles, Reducer, reduce_by_key
from weir.streaming.fanout import fan_out, parquet_writer

AT = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]


class Longest(Reducer):
    """Largest absolute value and number of values: a state of two numbers."""

    out_type = T.StringType()

    def init(self):
        return np.zeros(2).tobytes()

    def reduce(self, state, values):
        return self.merge(state, np.array([np.abs(values).max(), len(values)]).tobytes())

    def merge(self, a, b):
        (x, n), (y, m) = np.frombuffer(a), np.frombuffer(b)
        return np.array([max(x, y), n + m]).tobytes()

    def finish(self, state):
        top, n = np.frombuffer(state)
        return f"{top:g}/{n:g}"


def values(n=30_000):
    """A third of all rows belong to one key; zeros, negative values, null keys and values."""
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{rnd.randrange(50)}"
        v = rnd.choice([0.0, rnd.expovariate(0.01), -rnd.expovariate(1.0), rnd.paretovariate(0.5)])
        rows.append((key, i % 2, None if i % 17 == 0 else v))
    return rows


def test_quantiles_within_the_error(spark):
    rows = values()
    df = spark.createDataFrame(rows, "key string, `odd.name` int, v double").repartition(16)
    got = {(r[0], r[1]): r["result"] for r in reduce_by_key(df, ["key", "odd.name"], "v", Quantiles(AT)).collect()}
    exact = {}
    for key, odd, v in rows:
        exact.setdefault((key, odd), []).extend([] if v is None else [v])
    assert got.keys() == exact.keys()
    for key, vs in exact.items():
        vs.sort()
        for q, found in zip(AT, got[key]):
            want = vs[math.floor(q * (len(vs) - 1))]
            assert abs(found - want) <= 0.01 * abs(want) * (1 + 1e-9), (key, q)


def test_quantiles_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(values(5000), "key string, odd int, v double")
    one, many = (sorted(map(str, reduce_by_key(df.repartition(n), ["key"], "v", Quantiles(AT)).collect())) for n in (1, 13))
    assert one == many


def test_own_reducer_many_keys_and_odd_tables(spark):
    df = spark.range(20_000, numPartitions=4).select((F.col("id") % 6000).alias("k"), F.timestamp_micros(F.col("id") % 6000).alias("t"), (-F.col("id")).alias("v"))
    got = reduce_by_key(df, ["k", "t"], "v", Longest())
    want = df.groupBy("k", "t").agg(F.concat_ws("/", F.max(F.abs("v")), F.count("v")).alias("result"))
    assert got.exceptAll(want).isEmpty() and got.count() == 6000
    assert reduce_by_key(df.limit(0), ["k"], "v", Longest()).count() == 0
    nothing = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", None)], "k string, v double")
    assert {r["k"]: r["result"] for r in reduce_by_key(nothing, ["k"], "v", Quantiles([0.5])).collect()} == {"a": None, "b": None}
    with pytest.raises(ValueError):
        reduce_by_key(df, [], "v", Longest())


def test_rows_before_the_shuffle_are_states(spark):
    """A hot key sends a state per task, not its rows."""
    df = spark.range(100_000, numPartitions=8).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    plan = reduce_by_key(df, ["k"], "v", Quantiles([0.5]))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") < plan.index("MapInArrow")


def numbers(spark, folder, parts):
    for k in range(parts):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_failed_writer_is_repeated_alone(spark, tmp_path):
    stream = numbers(spark, f"{tmp_path}/in", 4)
    calls, broken = [], [True]

    def counted(rows, batch_id):
        calls.append(batch_id)
        parquet_writer(f"{tmp_path}/first")(rows, batch_id)

    def fails(rows, batch_id):
        parquet_writer(f"{tmp_path}/second")(rows.limit(3) if batch_id == 2 and broken[0] else rows, batch_id)
        if batch_id == 2 and broken[0]:
            raise RuntimeError("writer stopped in mid-batch")

    writers = {"fails": fails, "first": counted}
    with pytest.raises(Exception, match="writer stopped"):
        fan_out(stream, writers, f"{tmp_path}/run")
    assert calls == [0, 1, 2]
    broken[0] = False
    fan_out(stream, writers, f"{tmp_path}/run")
    assert calls == [0, 1, 2, 3]
    for sink in ("first", "second"):
        assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/{sink}").collect()) == list(range(40))
    assert len(list((tmp_path / "run" / "notes").iterdir())) == 1 == len([p for p in (tmp_path / "run" / "rows").iterdir() if not p.name.startswith(".")])
