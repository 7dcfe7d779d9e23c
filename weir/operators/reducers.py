"""User reducers as partial and final steps.

A reducer folds the values of a key into a state. Every task folds its own rows and
sends one state per key on, so no task ever holds all rows of a key; the states
of a key are merged in two steps, first in ``parallelism ** 0.5`` parts, then over the parts.

States travel as bytes. ``merge`` must be associative and commutative, as the
order of the parts is not fixed. Null values are not handed to ``reduce``; a key with null values
only has the state of ``init``. Null keys are a group of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import parallelism

# Keys a task folds at once; beyond them it sends its states on and starts anew.
KEYS_HELD = 4096
STATE, PART = "__state", "__part"


class Reducer(ABC):
    """Fold of one numeric column. All methods run in tasks, on one state at a time."""

    out_type: T.DataType = T.BinaryType()

    @abstractmethod
    def init(self) -> bytes:
        """State of no values."""

    @abstractmethod
    def reduce(self, state: bytes, values: np.ndarray) -> bytes:
        """State with some more values of its key."""

    @abstractmethod
    def merge(self, a: bytes, b: bytes) -> bytes:
        """State of the values of both."""

    def finish(self, state: bytes):
        """The result of a key, of type ``out_type``."""
        return state


def reduce_by_key(df: DataFrame, keys: Sequence[str], value: str, reducer: Reducer, out: str = "result") -> DataFrame:
    """(keys, out): the values of every key folded by the reducer. At least one key."""
    names = list(keys)
    if not names:
        raise ValueError("reduce_by_key needs a key")
    # Keys go by number inside, whatever their names.
    inner = [f"k{i}" for i in range(len(names))]
    slim = df.select(*[F.col(f"`{k}`").alias(i) for k, i in zip(names, inner)], F.col(f"`{value}`").cast("double").alias(STATE))
    parts = T.StructType([*slim.schema.fields[:-1], T.StructField(STATE, T.BinaryType()), T.StructField(PART, T.LongType())])
    width = max(1, math.isqrt(parallelism(df.sparkSession)))

    def whole(states: pd.Series) -> bytes:
        state = reducer.init()
        for part in states:
            state = reducer.merge(state, part)
        return state

    @F.pandas_udf(T.BinaryType())
    def merged(states: pd.Series) -> bytes:
        return whole(states)

    @F.pandas_udf(reducer.out_type)
    def finished(states: pd.Series) -> object:
        return reducer.finish(whole(states))

    held = slim.mapInArrow(_partial(reducer, len(names), width), parts)
    held = held.groupBy(*inner, PART).agg(merged(STATE).alias(STATE)).groupBy(*inner).agg(finished(STATE).alias(STATE))
    return held.select(*[F.col(i).alias(k) for k, i in zip(names, inner)], F.col(STATE).alias(out))


def _partial(reducer: Reducer, n_keys: int, width: int):
    """Map step: states per key over the Arrow batches of a task."""

    inner = [f"k{i}" for i in range(n_keys)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % width
        held: dict[tuple, bytes] = {}
        types: list[pa.DataType] = []

        def states() -> pa.RecordBatch:
            of_key = [pa.array([k[i] for k in held], types[i]) for i in range(n_keys)]
            return pa.RecordBatch.from_arrays([*of_key, pa.array(held.values(), pa.binary()), pa.array([part] * len(held), pa.int64())], names=[*inner, STATE, PART])

        for batch in batches:
            types = batch.schema.types[:n_keys]
            lists = pa.Table.from_batches([batch]).group_by(inner, use_threads=False).aggregate([(STATE, "list")])
            of_key = [lists.column(k).to_pylist() for k in inner]
            for key, values in zip(zip(*of_key), lists.column(f"{STATE}_list").combine_chunks()):
                found = values.values.drop_null().to_numpy(zero_copy_only=False)
                state = held[key] if key in held else reducer.init()
                held[key] = reducer.reduce(state, found) if len(found) else state
            if len(held) > KEYS_HELD:
                yield states()
                held.clear()
        if held:
            yield states()

    return fold


class Quantiles(Reducer):
    """Quantiles with a bounded relative error, from counts of logarithmic buckets.

    Bucket b holds the values in (g^(b-1), g^b] with g = (1 + error) / (1 - error) and
    answers 2 g^b / (g + 1), at most ``error`` times the value away from each of them (Masson, Rim and
    Lee, 2019). Merging adds counts, so a result does not depend on order or
    partitions. Zeros, positive and negative values are counted apart; NaN and infinities are left out.
    The q-quantile is that of rank floor(q (n - 1)) from 0; without values it is null.
    A state has at most some 1,400 / (2 error) buckets a sign, whatever the rows.
    """

    out_type = T.ArrayType(T.DoubleType())
    _ROW = np.dtype([("bucket", "<i8"), ("n", "<i8")])
    # Buckets of negative values, zero and positive values lie in disjoint, ordered ranges.
    _SIDE = 1 << 40

    def __init__(self, at: Sequence[float], error: float = 0.01) -> None:
        self.at, self.error = list(at), error
        self.base = (1 + error) / (1 - error)

    def init(self) -> bytes:
        return b""

    def reduce(self, state: bytes, values: np.ndarray) -> bytes:
        values = values[np.isfinite(values)]
        with np.errstate(divide="ignore"):
            size = np.ceil(np.log(np.abs(values)) / math.log(self.base))
        place = np.where(values == 0, 0, np.sign(values) * (self._SIDE + np.where(values == 0, 0, size)))
        bucket, n = np.unique(place.astype("i8"), return_counts=True)
        rows = np.empty(len(bucket), self._ROW)
        rows["bucket"], rows["n"] = bucket, n
        return self.merge(state, rows.tobytes())

    def merge(self, a: bytes, b: bytes) -> bytes:
        rows = np.frombuffer(a + b, self._ROW)
        bucket, of = np.unique(rows["bucket"], return_inverse=True)
        out = np.zeros(len(bucket), self._ROW)
        out["bucket"] = bucket
        np.add.at(out["n"], of, rows["n"])
        return out.tobytes()

    def finish(self, state: bytes) -> list[float] | None:
        rows = np.frombuffer(state, self._ROW)
        if not len(rows):
            return None
        upto = np.cumsum(rows["n"])
        ranks = [math.floor(q * (int(upto[-1]) - 1)) for q in self.at]
        return [self._value(int(rows["bucket"][np.searchsorted(upto, r, side="right")])) for r in ranks]

    def _value(self, bucket: int) -> float:
        if bucket == 0:
            return 0.0
        return math.copysign(2 * self.base ** (abs(bucket) - self._SIDE) / (self.base + 1), bucket)
