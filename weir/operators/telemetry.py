"""Latency and queue telemetry: windows, rollups, traces, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cmv
from ..functions.time import bucket_start
from ..scale import GroupCount, Lag, LastValue, RowNumber, RunningSum, dense_int_index, ordered_scan, range_scan
from ..session import materialize
from ..sources import metric_lines as L

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


# --- windows and CMV tables -------------------------------------------------


def cmv_window(samples: DataFrame, width_ms: int, keys: Sequence[str], value: str = "ms", time_ms: str = "time") -> DataFrame:
    """Count, sum and sum of squares per tumbling window and key."""
    timed = samples.withColumn("window_start", bucket_start(time_ms, width_ms))
    return timed.groupBy("window_start", *keys).agg(*cmv.accumulate(value))


def cmv_stats(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("avg", cmv.avg()).withColumn("avg2", cmv.avg2())
        .withColumn("var", cmv.variance()).withColumn("scv", cmv.scv())
    )


def cmv_merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*cmv.merge())


def cmv_merge_windows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add window rows; windows with count 0 go to ``empty`` instead of the sums."""
    return df.groupBy(*keys).agg(*cmv.merge_windows())


def elapsed(df: DataFrame, start_ns: str, end_ns: str) -> DataFrame:
    """Adds ``elapsed_ms``; rows without a positive duration are dropped."""
    timed = df.withColumn("elapsed_ms", (F.col(end_ns) - F.col(start_ns)) / 1e6)
    return timed.where("elapsed_ms > 0")


# --- windowed reports -------------------------------------------------------


def _cmv_entry(metric: Column, stream: Column, ok: Column, cnt: Column, total: Column, total_2: Column) -> Column:
    return F.struct(
        metric.alias("metric"), stream.alias("stream"),
        F.when(ok, cnt).otherwise(0).cast("bigint").alias("cnt"),
        F.when(ok, total).otherwise(0.0).alias("total"),
        F.when(ok, total_2).otherwise(0.0).alias("total_2"),
        F.when(ok, 0).otherwise(1).cast("bigint").alias("empty"),
    )


def measurements(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Parsed reports in long form: (keep..., metric, stream, cnt, total, total_2, empty).

    ``metric`` is ``process`` or ``<queue>-length | -samples | -arrivals``. All
    kinds leave one explode, so one scan and one shuffle serve them all.
    """

    def process(e: Column) -> Column:
        p = F.split(e["value"], ",")
        n, total, total_2 = F.get(p, F.lit(0)).try_cast("bigint"), F.get(p, F.lit(1)).try_cast("double"), F.get(p, F.lit(2)).try_cast("double")
        # A statistic that can't be read counts as an empty one.
        good = F.coalesce((n > 0) & total.isNotNull() & total_2.isNotNull(), F.lit(False))
        return _cmv_entry(F.lit("process"), e["key"], good, n, total, total_2)

    def queue(e: Column) -> Column:
        def counter(name: str) -> Column:
            return F.coalesce(e["value"][name].try_cast("double"), F.lit(0.0))

        samples, length, arrivals = counter("sampleCount"), counter("totalQueueLen"), counter("totalCount")
        mean = length / F.nullif(samples, F.lit(0.0))
        one, none = F.lit(1), F.lit("")
        return F.array(
            _cmv_entry(F.concat(e["key"], F.lit("-length")), none, samples > 0, one, mean, mean * mean),
            _cmv_entry(F.concat(e["key"], F.lit("-samples")), none, samples > 0, one, samples, samples * samples),
            _cmv_entry(F.concat(e["key"], F.lit("-arrivals")), none, arrivals > 0, one, arrivals, arrivals * arrivals),
        )

    entries = F.concat(
        F.transform("process", process),
        F.flatten(F.transform(F.map_entries("queues"), queue)),
    )
    return parsed.select(*keep, F.inline(entries))


def process_stats(parsed: DataFrame) -> DataFrame:
    """Processing statistics per task and stream."""
    rows = measurements(parsed, ["cid", "type"]).where("metric = 'process'")
    return cmv_stats(cmv_merge(rows, ["cid", "type", "stream"]))


def queue_stats(parsed: DataFrame) -> DataFrame:
    """Queue length, sample and arrival statistics per task and queue."""
    rows = measurements(parsed, ["cid", "type"]).where("metric <> 'process'")
    return cmv_stats(cmv_merge(rows, ["cid", "type", "metric"]))


def component_rollup(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Task rows merged per component, type, metric and stream."""
    return cmv_merge(rows, [*keep, "component", "type", "metric", "stream"])


def combine_streams(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Processing rows of all streams merged per component."""
    return cmv_merge(rows.where("metric = 'process'"), [*keep, "component", "type"])


def known_components(rows: DataFrame, cluster: DataFrame, keys: Sequence[str] = ("component", "task")) -> DataFrame:
    """Rows of deployed tasks only."""
    return rows.join(cluster.select(*keys), list(keys), "left_semi")


def snapshot_ffill(reports: DataFrame, keys: Sequence[str], cycle: str = "cycle") -> DataFrame:
    """Each report repeated in the cycles up to the next report of its key.

    Cycles without any report do not exist. ``reports`` has one row per key and
    cycle, so a key has at most as many rows as there are cycles.
    """
    # Both are read several times below; the reports themselves only once.
    reports = materialize(reports)
    cycles = materialize(dense_int_index(reports.select(cycle).distinct(), cycle, "__idx"))
    indexed = reports.join(cycles, cycle)
    last = cycles.select(F.max("__idx") + 1).scalar()
    # The previous row in backward order is the next report of the key.
    back = ordered_scan(indexed.withColumn("__back", -F.col("__idx")), keys, ["__back"], [Lag("__next", "__idx")])
    until = back.withColumn("__until", F.coalesce("__next", last)).drop("__back", "__next")
    spread = until.withColumn("__at", F.explode(F.sequence(F.col("__idx"), F.col("__until") - 1)))
    spread = spread.withColumnRenamed(cycle, "reported_cycle").drop("__idx", "__until")
    return spread.join(cycles.withColumnRenamed("__idx", "__at"), "__at").drop("__at")


def rolling_history(rows: DataFrame, keys: Sequence[str], cycle: str = "cycle", size: int = 4, width: int = 1000 * DAY_MS) -> DataFrame:
    """CMV columns summed over the last ``size`` cycles of each key.

    ``rows`` has one row per key and cycle; ``width`` is in units of ``cycle``.
    """
    ranked = ordered_scan(materialize(rows), keys, [cycle], [RowNumber("__r")], width)
    r = F.col("__r")
    # Each row adds to its own cycle and to the size - 1 cycles that follow.
    spread = ranked.withColumn("__at", F.explode(F.sequence(r, r + (size - 1))))
    sums = [F.sum(c).alias(c) for c in cmv.CMV]
    own = F.max(F.when(F.col("__at") == r, F.col(cycle))).alias(cycle)
    merged = spread.groupBy(*keys, "__at").agg(own, *sums, F.count(F.lit(1)).alias("cycles"))
    return merged.where(F.col(cycle).isNotNull()).drop("__at")


def execution_load(parsed: DataFrame) -> DataFrame:
    """(key, component, task, cnt, cost) per task with executions, key = comp:task in 3 digits."""
    rows = L.explode_process(parsed, ["component", "task"], "execute").where("cnt > 0")
    sums = rows.groupBy("component", "task").agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("cost"))
    return sums.select(F.format_string("%s:%03d", "component", "task").alias("key"), "component", "task", "cnt", "cost").orderBy("key")


def key_prefix_range(df: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys in [prefix, prefix + ';'): two plain comparisons that reach the scan."""
    return df.where((F.col(key) >= prefix) & (F.col(key) < prefix + ";"))


def even_groups(df: DataFrame, groups: int, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``tile``: contiguous groups per key, the first n mod g one row larger."""
    ranked = ordered_scan(df, keys, [order], [RowNumber("__r"), GroupCount("__n")])
    n, r = F.col("__n"), F.col("__r") - 1
    base, extra = F.floor(n / groups), n % groups
    wide = extra * (base + 1)
    tile = F.when(r < wide, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - wide) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("tile", (tile + 1).cast("bigint")).drop("__n", "__r")


# --- latest values ----------------------------------------------------------


def latest_metric(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Last value per key; the order columns decide, so replays agree."""
    return points.groupBy(*keys).agg(F.max_by(F.struct(value, *order), F.struct(*order)).alias("__v")).select(
        *keys, f"__v.{value}", *[f"__v.{o}" for o in order]
    )


def latest_counters(points: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """(keys, counter, value, order): the last value of every map key, so that maps merge key by key over older ones."""
    each = points.select(*keys, order, F.explode(value).alias("counter", "value"))
    return newest(each, [*keys, "counter"], order)


def newest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key; of equal ones the greater value, so replays agree."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, "value")).alias("__v"))
    return best.select(*keys, "__v.value", f"__v.{order}")


# --- traces -----------------------------------------------------------------


def sample_traces(df: DataFrame, trace: str, rate: int, hashed: Column | None = None) -> DataFrame:
    """Keep a trace when its hash is a multiple of ``rate``."""
    h = F.xxhash64(trace) if hashed is None else hashed
    return df.where(F.pmod(h, F.lit(rate)) == 0)


def correlate_traces(completions: DataFrame, executions: DataFrame, trace: str = "trace", keep_unmatched: bool = True) -> DataFrame:
    """Completions with the executions of their trace, one row per execution.

    The inner part joins the many executions with unique completions, which
    lets adaptive execution split a hot trace; completions without executions
    are added with nulls.
    """
    matched = executions.join(completions, trace)
    if not keep_unmatched:
        return matched
    missing = completions.join(executions.select(trace).distinct(), trace, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)


def pair_latency(starts: DataFrame, outcomes: DataFrame, trace: str = "trace") -> DataFrame:
    """Latency of finished rows, -1 for failures: starts(trace, start), outcomes(trace, end, failed)."""
    latency = F.when(F.col("failed"), F.lit(-1)).otherwise(F.col("end") - F.col("start"))
    return outcomes.join(starts, trace).select(trace, latency.cast("bigint").alias("latency"))


def completed_aggregate(paired: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, sum and sum of squares of the latencies that did not fail."""
    done = paired.where("latency >= 0").select(*keys, F.col("latency").cast("double").alias("x"))
    return done.groupBy(*keys).agg(*cmv.accumulate("x"))


def collect_traces(executions: DataFrame, width_ms: int, record: Column, seq: str, time_ms: str, keys: Sequence[str] = ("component", "trace")) -> DataFrame:
    """Execution records per window and key in long form: (window_start, keys..., pos, record).

    ``pos`` counts from 1 in the order of the records; no list is built, so a key may
    have any number of records.
    """
    timed = executions.select(bucket_start(time_ms, width_ms).alias("window_start"), *keys, record.alias("record"), seq)
    group = ["window_start", *keys]
    return range_scan(timed, group, ["record", seq], [RowNumber("pos")]).select(*group, "pos", "record")


def traced_stats(traced: DataFrame) -> DataFrame:
    """Count, total, mean and variance of the durations per component."""
    sums = traced.groupBy("component").agg(*cmv.accumulate("duration"))
    return sums.select("component", "cnt", "total", cmv.avg().alias("avg"), cmv.variance().alias("var"))


def traced_avg_simple(lines: DataFrame, text: str = "text") -> DataFrame:
    """Mean of field 1 per component, and the integer mean latency over all parsed lines."""
    traced = L.parse_traced(lines, text)
    means = traced.where(F.col("component") != L.COMPLETE).groupBy("component").agg(F.avg("field1").alias("avg"))
    maps = lines.select(F.from_json(text, "map<string,string>").alias("m")).where("m IS NOT NULL")
    latency = F.coalesce(F.col("m")[L.COMPLETE].cast("bigint"), F.lit(0))
    total = maps.agg(F.sum(latency).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = F.when(F.col("n") > 0, F.expr("s div nullif(n, 0)")).cast("double")
    return means.unionByName(total.select(F.lit(L.COMPLETE).alias("component"), whole.alias("avg")))


# --- other ------------------------------------------------------------------


def numeric_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: count, sum, mean, variance; mean and variance are 0 on empty input."""
    sums = df.agg(*cmv.accumulate(value))
    return sums.select("cnt", "total", cmv.avg().alias("avg"), cmv.variance().alias("var"))


def expand_ranges(executors: DataFrame, keep: Sequence[str] = ("component",)) -> DataFrame:
    """Inclusive [start, end] task ranges -> one row per task."""
    return executors.select(*keep, F.explode(F.sequence("start", "end")).alias("task"))


def tasks_by_component(executors: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Sorted task ids per component; a component has as many as the cluster runs."""
    chosen = executors.where(predicate) if predicate is not None else executors
    return expand_ranges(chosen).groupBy("component").agg(F.array_sort(F.collect_list("task")).alias("tasks"))


def is_system(component: str = "component") -> Column:
    return F.col(component).startswith(L.SYSTEM_PREFIX)


def greedy_cuts(times: DataFrame, interval_ms: int, key: str = "component", time: str = "time", width_ms: int = HOUR_MS) -> DataFrame:
    """(key, time) of the first mark of each key and of all following cuts.

    A cut is the first mark later than the previous cut + interval. Each mark
    gets a pointer to the mark that would follow it; pointers are composed with
    themselves, so the chain of cuts is found in log2(length) joins and no key
    is walked in one task.
    """
    return _cuts(materialize(times.select(key, time).distinct()), interval_ms, key, time, width_ms)


def _cuts(marks: DataFrame, interval_ms: int, key: str, time: str, width_ms: int) -> DataFrame:
    # Scan backwards in time; a question at t + interval sees marks strictly later.
    t = F.col(time)
    asked = F.array(
        F.struct((-t - interval_ms).alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("mark")),
        F.struct((-t).alias("x"), F.lit(1).alias("kind"), t.alias("mark")),
    )
    events = marks.withColumn("e", F.explode(asked)).select(key, time, "e.*")
    seen = ordered_scan(events, [key], ["x", "kind"], [LastValue("next", "mark")], width_ms)
    jumps = [materialize(seen.where("kind = 0 AND next IS NOT NULL").select(key, time, "next"))]
    # Cuts lie more than an interval apart, which bounds the chain.
    span = marks.agg(F.max(time) - F.min(time)).first()[0] or 0
    for _ in range((span // (interval_ms + 1) + 1).bit_length() - 1):
        near = jumps[-1]
        far = near.select(key, F.col(time).alias("next"), F.col("next").alias("far"))
        jumps.append(materialize(near.join(far, [key, "next"]).select(key, time, F.col("far").alias("next"))))
    cuts = marks.groupBy(key).agg(F.min(time).alias(time))
    for jump in jumps:
        # Cuts 0..n-1 lead to cuts n..2n-1, so no cut appears twice.
        ends = F.array_compact(F.array(time, "next"))
        cuts = cuts.join(jump, [key, time], "left").select(key, F.explode(ends).alias(time))
    return cuts


def greedy_segments(rows: DataFrame, interval_ms: int, value: str, key: str = "component", time: str = "time", width_ms: int = HOUR_MS) -> DataFrame:
    """Load per greedy segment: (key, segment, start_time, end_time, cnt, load).

    Segment i ends where cut i is made; rows from the last cut on are dropped.
    """
    per_time = materialize(rows.groupBy(key, time).agg(F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("load")))
    cuts = _cuts(per_time.select(key, time), interval_ms, key, time, width_ms).withColumn("cut", F.lit(1))
    marked = materialize(per_time.join(cuts, [key, time], "left").fillna(0, ["cut"]))
    numbered = ordered_scan(marked, [key], [time], [RunningSum("segment", "cut")], width_ms)
    loads = materialize(numbered.groupBy(key, "segment").agg(
        F.min(time).alias("start_time"), F.sum("cnt").alias("cnt"), F.sum("load").alias("load")
    ))
    ends = loads.select(key, (F.col("segment") - 1).alias("segment"), F.col("start_time").alias("end_time"))
    return loads.join(ends, [key, "segment"]).select(
        key, F.col("segment").cast("bigint").alias("segment"), "start_time", "end_time", "cnt", "load"
    )
