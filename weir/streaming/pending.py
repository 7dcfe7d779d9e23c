"""Records that wait for others of their key, in keyed state with event-time timers.

A key's state goes to the task with its new rows and comes back with the result, so one
key (an object, or a bucket of traces) never needs more than its own waiting records. Nothing waits for the watermark
that is complete already: the watermark only moves the timers. Rows behind the
watermark are dropped by the engine, as in all event-time state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta(milliseconds=1))


def merge_on_last(flags: DataFrame, projections: int, event_time: str, expiry: str, keys: Sequence[str] = ("seq", "id", "obj_id"), delay: str = "0 seconds") -> DataFrame:
    """OR of the flags of an object, given out with the report that makes its projections complete.

    ``flags`` has the keys, ``projection_id``, ``is_outlier`` and an event time. A report
    that comes twice counts once. What is not complete ``expiry`` after its last
    report is forgotten; both complete and expired keys leave the state.
    """
    wait = _millis(expiry)
    names = list(keys)
    types = {f.name: f.dataType.simpleString() for f in flags.schema}
    out = ", ".join(f"{k} {types[k]}" for k in names) + ", is_outlier boolean"

    def run(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen, flag = state.get if state.exists else ([], False)
        seen, last = set(seen), 0
        for part in parts:
            seen.update(part["projection_id"].tolist())
            flag = flag or any(f for f in part["is_outlier"].tolist() if f is not None)
            last = max(last, int(part["__at"].max()))
        if len(seen) >= projections:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(*key, flag)], columns=[*names, "is_outlier"])
        else:
            state.update((sorted(seen), flag))
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    timed = flags.withColumn("__at", F.unix_millis(event_time)).withWatermark(event_time, delay)
    return timed.groupBy(*names).applyInPandasWithState(run, out, "seen array<int>, flag boolean", "append", GroupStateTimeout.EventTimeTimeout)


TRIES, STEP = 3, "60 seconds"
# Traces whose hash falls into one bucket share a call and a state row; fixed for the life of a folder.
BUCKETS = 2048
TRACED = "trace bigint, latency bigint, tries int, component string, arrival bigint, departure bigint"
# A row per waiting trace (trace to timer) and one per execution held for it (owner to departure).
WAITING = (
    "trace array<bigint>, done array<boolean>, latency array<bigint>, tries array<int>, due array<bigint>, timer array<bigint>, "
    "owner array<bigint>, component array<string>, arrival array<bigint>, departure array<bigint>"
)
FIRST, SECOND, TIME = 1, 2, 4  # bits of what is null in a row


def correlate_with_tries(
    completions: DataFrame, executions: DataFrame, tries: int = TRIES, step: str = STEP, forget: str = "30 minutes", delay: str = "0 seconds",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(trace, latency, tries, component, arrival, departure): a completed trace with its executions, a row each.

    completions(trace, latency, done_at) and executions(trace, component, arrival,
    departure, ran_at) travel as one stream. A completion whose trace has executions
    goes out at once, with 0 tries. Otherwise it is looked at again every ``step`` of event
    time; after the last of ``tries`` it goes out with what is there, nulls if nothing is. Executions of a
    trace that never completes are forgotten after ``forget``.

    A call takes the traces of a bucket together, as arrays: a call for each trace costs some milliseconds. A bucket
    holds the waiting records of its traces only; ``buckets`` sets how many traces share one.
    """
    wait, keep = _millis(step), _millis(forget)
    none = lambda t: F.lit(None).cast(t)
    done = completions.select("trace", F.lit(True).alias("done"), none("string").alias("component"), F.col("latency").cast("bigint").alias("first"), none("bigint").alias("second"), F.col("done_at").alias("at"))
    ran = executions.select("trace", F.lit(False).alias("done"), "component", F.col("arrival").cast("bigint").alias("first"), F.col("departure").cast("bigint").alias("second"), F.col("ran_at").alias("at"))
    both = done.unionByName(ran).withColumn("__at", F.unix_millis("at")).withWatermark("at", delay)
    # Numbers go without nulls, whose columns would come as floats. Null is a bucket and a trace of its own.
    bits = reduce(Column.__add__, (F.when(F.col(c).isNull(), b).otherwise(0) for c, b in (("first", FIRST), ("second", SECOND), ("__at", TIME))))
    bucket = F.when(F.col("trace").isNotNull(), F.pmod(F.xxhash64("trace"), F.lit(buckets))).alias("__bucket")
    whole = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("trace", "first", "second", "__at")]
    both = both.select(bucket, *whole, "done", "component", "at", bits.alias("nulls"))

    # Inside, so that they travel with ``run``: workers need not have the package.
    def optional(values, missing):
        return [None if m else v for v, m in zip(values.tolist(), missing.tolist())]

    def known(values):
        """Numbers, with 0 where there is none, and where that is."""
        return np.array([0 if v is None else v for v in values], np.int64), np.array([v is None for v in values], bool)

    def run(key, parts, state):
        now = state.getCurrentWatermarkMs()
        old = state.get if state.exists else [[]] * 10
        kept, rows = np.array(old[0], np.int64), [] if state.hasTimedOut else list(parts)
        columns = ("trace", "first", "second", "__at", "done", "nulls", "component")
        joined = lambda c, t: np.concatenate([np.empty(0, t), *[part[c].to_numpy().astype(t, copy=False) for part in rows]])
        trace, first, second, at, ends, nulls, component = (joined(c, t) for c, t in zip(columns, (np.int64,) * 4 + (bool, np.int64, object)))
        traces, place = np.unique(np.concatenate([kept, trace]), return_inverse=True)
        had, place = place[: len(kept)], place[len(kept) :]
        n = len(traces)

        def carried(k, kind):
            values = np.zeros(n, kind)
            values[had] = np.array(old[k], kind)
            return values

        complete, count, due, timer = (carried(k, t) for k, t in ((1, bool), (3, np.int64), (4, np.int64), (5, np.int64)))
        latency, unknown = np.zeros(n, np.int64), np.zeros(n, bool)
        latency[had], unknown[had] = known(old[2])
        touched, fresh, last = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        touched[place] = True
        np.maximum.at(last, place, at)

        # The first completion of a trace counts.
        which, where = np.unique(place[ends], return_index=True)
        row = np.flatnonzero(ends)[where]
        which, row = which[~complete[which]], row[~complete[which]]
        complete[which], fresh[which] = True, True
        latency[which], unknown[which] = first[row], nulls[row] & FIRST > 0
        due[which] = np.where(nulls[row] & TIME > 0, now, at[row]) + wait

        # Executions held and new ones, by the place of their trace.
        arrival, departure = known(old[8]), known(old[9])
        owner = np.concatenate([np.searchsorted(traces, np.array(old[6], np.int64)), place[~ends]])
        component = np.concatenate([np.array(old[7], object), component[~ends]])
        arrival = [np.concatenate(x) for x in zip(arrival, (first[~ends], nulls[~ends] & FIRST > 0))]
        departure = [np.concatenate(x) for x in zip(departure, (second[~ends], nulls[~ends] & SECOND > 0))]
        held = np.bincount(owner, minlength=n) > 0

        # Timers of traces without new rows. The watermark may have passed several looks at once.
        rung = ~touched & (timer < now)
        looked = rung & complete
        looks = np.where(due <= now, (now - due) // wait + 1 if wait else tries, 0)
        looks = np.maximum(np.minimum(np.where(held, np.minimum(looks, 1), looks), tries - count), 0)
        count = np.where(looked, count + looks, count)
        due = np.where(looked & ~held, due + looks * wait, due)
        ready = (fresh & held) | (looked & (held | (count >= tries)))
        stays = ~ready & ~(rung & ~complete)  # executions of a trace that did not complete go

        out = ready[owner]
        alone = np.flatnonzero(ready & ~held)
        source = np.concatenate([owner[out], alone])
        if len(source):
            gap = np.ones(len(alone), bool)
            masked = lambda v, m: pd.arrays.IntegerArray(np.concatenate([v[out], alone * 0]), np.concatenate([m[out], gap]))
            names = np.concatenate([component[out], np.full(len(alone), None, object)])
            owners = pd.arrays.IntegerArray(traces[source], np.full(len(source), pd.isna(key[0])))
            times = pd.arrays.IntegerArray(latency[source], unknown[source])
            yield pd.DataFrame({"trace": owners, "latency": times, "tries": count[source].astype(np.int32), "component": names, "arrival": masked(*arrival), "departure": masked(*departure)})
        if not stays.any():
            if state.exists:
                state.remove()
            return
        timer = np.where(touched | rung, np.maximum(np.where(complete, due, last + keep), now + 1), timer)
        rest, on = np.flatnonzero(stays), stays[owner]
        state.update((
            traces[rest].tolist(), complete[rest].tolist(), optional(latency[rest], unknown[rest] | ~complete[rest]), count[rest].tolist(), due[rest].tolist(), timer[rest].tolist(),
            traces[owner[on]].tolist(), component[on].tolist(), optional(arrival[0][on], arrival[1][on]), optional(departure[0][on], departure[1][on]),
        ))
        state.setTimeoutTimestamp(int(timer[rest].min()))

    return both.groupBy("__bucket").applyInPandasWithState(run, TRACED, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
