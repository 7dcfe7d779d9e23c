"""Queue of rows with offsets: appended in segments, read as a stream or by ranges of offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import dense_index

SEGMENT_ROWS = 1 << 16
# Segments are dealt to consumers by their last digit, which a path pattern can name.
CONSUMERS = (1, 2, 5, 10)
OFFSET, SEGMENT = "offset", "segment"


class Queue:
    """Append-only table of rows with dense offsets from 0 on.

    A segment is a partition folder of ``size`` consecutive offsets, so its number is
    the offset index: a range of offsets opens its own segments only. An append adds one file to
    each segment it reaches. There is one producer at a time; an append that fails leaves
    no rows. The row columns must not be named ``offset`` or ``segment``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, size: int = SEGMENT_ROWS):
        taken = {OFFSET, SEGMENT} & {f.name.lower() for f in schema}
        if taken:
            raise ValueError(f"columns of the queue itself: {sorted(taken)}")
        self.spark, self.folder, self.size = spark, folder, size
        self.names = schema.names
        self.schema = T.StructType([T.StructField(OFFSET, T.LongType()), *schema.fields, T.StructField(SEGMENT, T.LongType())])

    def _last_segment(self) -> int | None:
        """The largest segment, from the names of the folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return max((int(n.split("=")[1]) for n in names if n.startswith(f"{SEGMENT}=")), default=None)

    def end(self) -> int:
        """The offset of the next row; only the last segment is read."""
        last = self._last_segment()
        if last is None:
            return 0
        return self._rows().where(F.col(SEGMENT) == last).agg(F.max(OFFSET)).first()[0] + 1

    def append(self, rows: DataFrame, order: list[str]) -> None:
        """Add rows in the order of ``order``, which must be unique."""
        numbered = dense_index(rows.select(*self.names), order, OFFSET)
        placed = numbered.withColumn(OFFSET, F.col(OFFSET) + F.lit(self.end()).cast("bigint"))
        placed = placed.withColumn(SEGMENT, F.floor(F.col(OFFSET) / self.size).cast("bigint"))
        # A segment is bounded, so one task may write it.
        placed.repartition(SEGMENT).write.mode("append").partitionBy(SEGMENT).parquet(self.folder)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def rows(self) -> DataFrame:
        """All rows with their offsets."""
        if self._last_segment() is None:
            return self.spark.createDataFrame([], self.schema).drop(SEGMENT)
        return self._rows().drop(SEGMENT)

    def scan(self, start: int, max_count: int) -> DataFrame:
        """Rows [start, start + max_count); nothing is consumed."""
        if self._last_segment() is None:
            return self.rows()
        stop = start + max(max_count, 0)
        segments = F.col(SEGMENT).between(start // self.size, (stop - 1) // self.size)
        return self._rows().where(segments & (F.col(OFFSET) >= start) & (F.col(OFFSET) < stop)).drop(SEGMENT)

    def stream(self, rows_per_trigger: int | None = None, consumer: int = 0, consumers: int = 1) -> DataFrame:
        """The rows as a stream, those of one append before those of the next one.

        A micro-batch takes at most ``rows_per_trigger`` rows, rounded down to whole segments, one at
        least. The stream's checkpoint keeps what was read, so a failed batch is read again with the same rows.
        Several ``consumers`` (1, 2, 5 or 10) share the queue: number ``consumer`` takes every segment whose
        number leaves that remainder, so all of them together read each row once. The order of appends holds for each alone.
        """
        if consumers not in CONSUMERS or not 0 <= consumer < consumers:
            raise ValueError(f"consumer {consumer} of {consumers}: the number of consumers must be one of {CONSUMERS}")
        reader = self.spark.readStream.schema(self.schema)
        if rows_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max(1, rows_per_trigger // self.size))
        if consumers == 1:
            return reader.parquet(self.folder).drop(SEGMENT)
        digits = "".join(str(d) for d in range(consumer, 10, consumers))
        return reader.option("basePath", self.folder).parquet(f"{self.folder}/{SEGMENT}=*[{digits}]").drop(SEGMENT)

    def streams(self, rows_per_trigger: int | None, consumers: int) -> list[DataFrame]:
        """The streams of all ``consumers``, each with batches of its own."""
        return [self.stream(rows_per_trigger, k, consumers) for k in range(consumers)]
