"""Telemetry lines: parse and encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entry names in telemetry lines.
COMPLETE = "_complete-latency"
SPOUT_KEY = "complete-latency"
BOLT_KEY = "execute"
SEND_QUEUE = "send-queue"
RECV_QUEUE = "recv-queue"
# Older queue names, accepted when strict is off.
OLD_NAMES = {"sendqueue": SEND_QUEUE, "receive": RECV_QUEUE}
# Raw metric name -> published name.
RENAMES = {
    "__sendqueue": "send-queue",
    "__receive": "recv-queue",
    "complete-latency": "complete-latency",
    "execute": "execute",
}
# Prefix of system components.
SYSTEM_PREFIX = "__"


def parse_traced(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per traced execution and one per complete latency.

    Columns: keep..., component, source, arrival, service, departure, field1,
    duration. Lines that are not JSON objects are skipped. Records have three
    or four fields; the fourth layout carries the service time in the middle.
    """
    entries = df.withColumn("__m", F.from_json(text, "map<string,string>")).where("__m IS NOT NULL")
    entries = entries.select(*keep, F.explode("__m").alias("component", "__v"))
    latency = F.col("component") == COMPLETE
    records = F.when(latency, F.array(F.lit(None).cast("string"))).otherwise(F.from_json("__v", "array<string>"))
    rows = entries.withColumn("__r", F.explode(records)).withColumn("__p", F.split("__r", ","))
    four = F.size("__p") == 4
    # A number that can't be read is null, and so is what follows from it.
    arrival = F.get("__p", F.lit(1)).try_cast("bigint")
    departure = F.when(four, F.get("__p", F.lit(3))).otherwise(F.get("__p", F.lit(2))).try_cast("bigint")
    duration = F.when(latency, F.col("__v").try_cast("double")).otherwise((departure - arrival).cast("double"))
    return rows.select(
        *keep, "component", F.get("__p", F.lit(0)).alias("source"), arrival.alias("arrival"),
        F.when(four, F.get("__p", F.lit(2)).try_cast("double")).alias("service"), departure.alias("departure"),
        F.get("__p", F.lit(1)).try_cast("double").alias("field1"), duration.alias("duration"),
    )


def parse_window(df: DataFrame, text: str = "text", keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """``comp:task[:time]->{json}`` -> (keep..., component, task, time, cid, type, process, queues).

    ``process`` and ``execute`` list (key, value): stream and "cnt,sum,sumsq";
    ``queues`` maps queue name -> counters. A task id that is no number is null, ``cid`` keeps it. Malformed lines and lines without latency or execution are skipped.
    """
    line = F.col(text)
    head, body = F.regexp_extract(line, r"^(.*?)->", 1), F.regexp_extract(line, r"->\s*(\{.*\})\s*$", 1)
    # Free-form reports: only the four entries are read as maps, others may be of any kind.
    parsed = df.withColumn("__h", F.split(head, ":")).withColumn("__m", F.from_json(body, "map<string,string>"))
    m, h = F.col("__m"), F.col("__h")
    entry = lambda name: F.from_json(F.when(F.substring(F.ltrim(m[name]), 1, 1) == "{", m[name]), "map<string,string>")
    spout, bolt = F.map_contains_key(m, SPOUT_KEY), F.map_contains_key(m, BOLT_KEY)
    parsed = parsed.where(m.isNotNull() & (F.size("__h") >= 2) & (spout | bolt))
    names = {SEND_QUEUE: [SEND_QUEUE], RECV_QUEUE: [RECV_QUEUE]}
    if not strict:
        for old, new in OLD_NAMES.items():
            names[new].append(old)
    queues = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(q), F.coalesce(*[entry(n) for n in ns])) for q, ns in names.items()]),
        lambda e: e["col2"].isNotNull(),
    ))
    none = F.create_map().cast("map<string,string>")
    execute = F.coalesce(entry(BOLT_KEY), none)
    # A line that has both entries counts both in the spout's result, also for the same stream.
    process = F.concat(F.map_entries(F.coalesce(entry(SPOUT_KEY), none)), F.map_entries(execute))
    return parsed.select(
        *keep, h[0].alias("component"), h[1].try_cast("int").alias("task"), F.get(h, F.lit(2)).try_cast("bigint").alias("time"),
        F.concat_ws(":", h[0], h[1]).alias("cid"), F.when(spout, "spout").otherwise("bolt").alias("type"),
        process.alias("process"), F.map_entries(execute).alias("execute"), queues.alias("queues"),
    )


def explode_process(parsed: DataFrame, keep: Sequence[str], entry: str = "process") -> DataFrame:
    """(keep..., stream, cnt, total, total_2) per reported stream."""
    rows = parsed.select(*keep, F.inline(entry)).withColumn("__p", F.split("value", ","))
    part = lambda i, kind: F.get("__p", F.lit(i)).try_cast(kind)
    return rows.select(*keep, F.col("key").alias("stream"), part(0, "bigint").alias("cnt"), part(1, "double").alias("total"), part(2, "double").alias("total_2"))


def encode_lines(points: DataFrame, keys: Sequence[str], name: str, value_json: str) -> DataFrame:
    """One JSON object per key; ``value_json`` holds JSON text of each metric.

    A group is one report of one task, so it has as many rows as metric names.
    """
    entry = F.concat(F.to_json(F.array(F.col(name))), F.lit(":"), F.col(value_json))
    # '["name"]:value' -> '"name":value'
    entry = F.regexp_replace(entry, r'^\[(".*?(?<!\\)")\]:', "$1:")
    lists = points.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__e"))
    return lists.select(*keys, F.concat(F.lit("{"), F.array_join("__e", ","), F.lit("}")).alias("json"))


def queue_layout(component: Column, task: Column, time: Column, json: Column) -> Column:
    """``[comp-task]:time:{json}``"""
    return F.concat(F.lit("["), component, F.lit("-"), task.cast("string"), F.lit("]:"), time.cast("string"), F.lit(":"), json)


def file_layout(component: Column, task: Column, json: Column) -> Column:
    """``[comp-task]:{json}``"""
    return F.concat(F.lit("["), component, F.lit("-"), task.cast("string"), F.lit("]:"), json)


def window_layout(component: Column, task: Column, json: Column) -> Column:
    """``comp:task->{json}``"""
    return F.concat(component, F.lit(":"), task.cast("string"), F.lit("->"), json)


def parse_encoded(df: DataFrame, line: str, value: str = "map<string,string>") -> DataFrame:
    """Read any of the three layouts back: adds component, task, time, metrics."""
    squared, arrow = r"^\[(.*)-(\d+)\]:(?:(\d+):)?\{", r"^(.*?):(\d+)(?::(\d+))?->"
    # Names may hold dashes: the task is what follows the last one.
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, squared, i), F.lit("")), F.nullif(F.regexp_extract(line, arrow, i), F.lit("")))
    json = F.regexp_extract(line, r"(\{.*\})\s*$", 1)
    found = df.withColumn("component", pick(1)).withColumn("task", pick(2).try_cast("int")).withColumn("time", pick(3).try_cast("bigint"))
    return found.withColumn("metrics", F.from_json(json, value))


def select_metrics(points: DataFrame, names: Sequence[str], component: str = "component", name: str = "name", value: str = "value") -> DataFrame:
    """Drop system components, unlisted names, null values, empty maps and lists."""
    kind = points.schema[value].dataType.typeName()
    kept = ~F.col(component).startswith(SYSTEM_PREFIX) & F.col(name).isin(list(names)) & F.col(value).isNotNull()
    if kind in ("map", "array"):
        kept = kept & (F.size(value) > 0)
    return points.where(kept)


def rename_metrics(points: DataFrame, renames: dict[str, str] = RENAMES, name: str = "name") -> DataFrame:
    """Published metric names; unmapped names become null."""
    table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    return points.withColumn(name, table[F.col(name)])
