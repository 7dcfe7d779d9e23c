"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import parallelism
from ..session import run_dir

# A word of a text: a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
# Rows of one Arrow batch: texts are long, so few rows already fill a batch.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches of Python workers small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Split hot keys of joins even where the next step then needs a shuffle of its own.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def with_columns(df: DataFrame, **new: Column) -> DataFrame:
    """Add columns; one that exists already (in any case of letters) is replaced."""
    low = {c.lower() for c in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


def text_key(text: str = "text") -> Column:
    """Hash of a text; with the id it names a document even when ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def stored(df: DataFrame) -> DataFrame:
    """Write a result to a Parquet folder below spark.checkpoint.dir and read it from there.

    Columnar and compressed, so for wide or long intermediate tables it takes a
    fraction of the disk of a checkpoint. The files outlive lost executors.
    """
    folder = run_dir(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Remove the files of ``stored`` results that nothing will read again."""
    folders = {f.rsplit("/", 1)[0] for df in frames if df is not None for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that are out of use, as it does whenever the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a written table of keys and the number ``n`` of their rows; hot keys are not shuffled.

    A key is hot if it has more than 1 / parallelism of the counted rows. There are
    fewer such keys than parallel tasks, whatever the data, so they are broadcast.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = total // parallelism(rows.sparkSession)
    hot = counted.where(F.col("n") > limit).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("__hot is null").select(*rows.columns).join(counted.where(F.col("n") <= limit), keys)
    return marked.where("__hot").drop("__hot").unionByName(cold)
