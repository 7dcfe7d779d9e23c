"""Last reports carried forward over the cycles in which their key is silent, as a stream.

A key's state is its last report, the next cycle to give out and the reports the
watermark has not passed yet. A timer per key rings for each cycle, so a silent
key gives out its row too. A cycle goes out once the watermark is past its start: from then on its
reports count as late. With no delay that is when any key reports in a later cycle.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

CARRIED = "next bigint, source bigint, body string, cycles array<bigint>, bodies array<string>"


def carry_forward(reports: DataFrame, keys: Sequence[str], cycle: str = "cycle", width: int = 86_400_000, delay: str = "0 seconds") -> DataFrame:
    """Reports with ``reported_cycle``: one row per key and cycle from the key's first report on.

    ``cycle`` is the start of a cycle in milliseconds; cycles of a key are ``width`` apart. Cycles without any
    report of any key exist here, unlike in the batch form. Of several reports of a key in one cycle the
    one with the largest JSON form counts. Reports ``delay`` behind the newest one are dropped; without
    a cycle they are left out.
    """
    names = list(keys)
    rest = [f for f in reports.schema.fields if f.name not in (*names, cycle)]
    types = {f.name: f.dataType.simpleString() for f in reports.schema}
    out = ", ".join([f"`{k}` {types[k]}" for k in names] + ["__cycle bigint", "__source bigint", "__body string"])

    def run(key, parts, state):
        now = state.getCurrentWatermarkMs()
        upcoming, source, body, cycles, bodies = state.get if state.exists else (None, None, None, [], [])
        waiting = dict(zip(cycles, bodies))
        if not state.hasTimedOut:
            for part in parts:
                for at, report in zip(part["__cycle"].tolist(), part["__body"]):
                    waiting[at] = max(waiting.get(at, ""), report)
        if source is None:
            upcoming = min(waiting)
        rows = []
        while upcoming <= now:
            if upcoming in waiting:
                source, body = upcoming, waiting.pop(upcoming)
            rows.append((*key, upcoming, source, body))
            upcoming += width
        state.update((upcoming, source, body, list(waiting), list(waiting.values())))
        state.setTimeoutTimestamp(max(upcoming - 1, now + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[*names, "__cycle", "__source", "__body"])

    body = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in rest]))
    timed = reports.where(F.col(cycle).isNotNull()).select(*[F.col(f"`{k}`") for k in names], F.col(cycle).cast("bigint").alias("__cycle"), body.alias("__body"))
    # A millisecond more, so that reports of the newest cycle may come in several batches.
    timed = timed.withColumn("__time", F.timestamp_millis("__cycle")).withWatermark("__time", f"{delay} 1 millisecond")
    spread = timed.groupBy(*[f"`{k}`" for k in names]).applyInPandasWithState(run, out, CARRIED, "append", GroupStateTimeout.EventTimeTimeout)
    back = F.from_json("__body", T.StructType(rest)).alias("__back")
    spread = spread.select(*[F.col(f"`{k}`") for k in names], F.col("__cycle").alias(cycle), F.col("__source").alias("reported_cycle"), back)
    return spread.select(*[F.col(f"`{k}`") for k in names], cycle, "reported_cycle", *[F.col(f"__back.`{f.name}`").alias(f.name) for f in rest])
