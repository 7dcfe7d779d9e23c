"""Line records: queue rows, signed sentences, object rows, numeric and transition lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import bucket_start
from ..scale import dense_int_index


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row ``text`` per line."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Replayable queue: every new file in ``path`` adds its lines."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).withColumnRenamed("value", "text")


def parse_signed(df: DataFrame, text: str = "text") -> DataFrame:
    """``+sentence`` / ``-sentence`` -> (sentence, is_add)."""
    return df.select(
        *[c for c in df.columns if c != text],
        F.substr(F.col(text), F.lit(2)).alias("sentence"),
        (F.substring(text, 1, 1) == "+").alias("is_add"),
    )


def parse_object(df: DataFrame, object_count: int, text: str = "text") -> DataFrame:
    """``seq|time|v1,v2,...`` -> (seq, id, vector, time) with id = seq mod object_count."""
    parts = F.split(text, r"[|]")
    # Fields that are missing or no numbers become null; no line ends the job.
    seq = F.get(parts, F.lit(0)).try_cast("bigint")
    return df.select(
        seq.alias("seq"),
        (seq % object_count).alias("id"),
        F.transform(F.split(F.get(parts, F.lit(2)), ","), lambda x: x.try_cast("double")).alias("vector"),
        F.get(parts, F.lit(1)).try_cast("bigint").alias("time"),
    )


def encode_record(seq: Column, time_ms: Column, line: Column) -> Column:
    return F.concat_ws("|", seq.cast("string"), time_ms.cast("string"), line)


def encode_addition(line: Column) -> Column:
    return F.concat(F.lit("+"), line)


def scan_range(df: DataFrame, start: int, max_count: int, seq: str = "seq") -> DataFrame:
    """Rows [start, start + max_count) of a queue; the bounds reach the file scan."""
    return df.where((F.col(seq) >= start) & (F.col(seq) < start + max_count))


def batch_by_count(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Adds ``batch``: consecutive groups of ``size`` rows in ``seq`` order."""
    indexed = dense_int_index(df, seq, "__index")
    return indexed.withColumn("batch", F.floor(F.col("__index") / size).cast("bigint")).drop("__index")


def batch_by_time(df: DataFrame, width_ms: int, time_ms: str = "time") -> DataFrame:
    """Adds ``batch_start``: tumbling windows of event time."""
    return df.withColumn("batch_start", bucket_start(time_ms, width_ms))


def parse_numeric_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed non-blank lines as doubles; lines that are no number are left to ``bad_numeric_lines``."""
    return df.withColumn("w", F.trim(text).try_cast("double")).where("w is not null").drop(text)


def bad_numeric_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank lines that are no number."""
    return df.where((F.trim(text) != "") & F.trim(text).try_cast("double").isNull())


def _transition(text: str) -> list:
    """The three fields of a line, null where there is none or the last one is no number."""
    parts = F.split(text, ":")
    return [F.get(parts, 0).alias("from_state"), F.get(parts, 1).alias("to_state"), F.get(parts, 2).try_cast("double").alias("p")]


def parse_transitions(df: DataFrame, text: str = "text") -> DataFrame:
    """``from:to:p`` -> (from_state, to_state, p); a repeated pair is an error, other lines are left to ``bad_transitions``."""
    rows = df.select(*_transition(text)).where("p is not null")
    once = rows.groupBy("from_state", "to_state").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("n"))
    repeated = F.concat_ws(" ", F.lit("repeated transition"), "from_state", "to_state")
    p = F.when(F.col("n") == 1, F.col("p")).otherwise(F.raise_error(repeated).cast("double"))
    return once.select("from_state", "to_state", p.alias("p"))


def bad_transitions(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines without three fields or without a number in the last one."""
    return df.where(_transition(text)[2].isNull())
