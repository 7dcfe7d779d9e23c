"""One stream, several consumers: every micro-batch goes to every writer once.

A ledger notes per writer which batch it has finished. If a writer fails, the
others still get the batch, the run then stops with the writer's error, and
when it is started again the batch goes to the unfinished writers alone. The rows of a batch are
written once before the first writer sees them, so that all writers and all repeats get the
same rows and nothing is computed twice. Notes and rows of older batches are removed.

A writer is called with (rows, batch_id). It can be called twice for a batch if the
process ends between its work and its note, so it has to replace what it wrote for that id, as
``parquet_writer`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .runs import drain_batches

Writer = Callable[[DataFrame, int], None]


def parquet_writer(folder: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Writer:
    """Writer of ``change(rows)`` to one folder per batch."""

    def write(rows: DataFrame, batch_id: int) -> None:
        change(rows).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


class Ledger:
    """Notes of finished work: an empty file per writer and batch."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _note(self, writer: str, batch_id: int):
        return self._path(f"{self.folder}/{batch_id}/{writer}")

    def done(self, writer: str, batch_id: int) -> bool:
        return self._files.exists(self._note(writer, batch_id))

    def note(self, writer: str, batch_id: int) -> None:
        self._files.create(self._note(writer, batch_id), True).close()

    def forget_before(self, batch_id: int) -> None:
        """Remove what older batches left; they are committed and won't come again."""
        place = self._path(self.folder)
        if self._files.exists(place):
            for entry in self._files.listStatus(place):
                if int(entry.getPath().getName()) < batch_id:
                    self._files.delete(entry.getPath(), True)


def fan_out(stream: DataFrame, writers: Mapping[str, Writer], folder: str) -> None:
    """Run until the source is empty. ``folder`` keeps offsets, rows and notes between runs."""
    spark = stream.sparkSession
    schema = stream.schema
    notes, kept = Ledger(spark, f"{folder}/notes"), Ledger(spark, f"{folder}/rows")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        notes.forget_before(batch_id)
        kept.forget_before(batch_id)
        place = f"{folder}/rows/{batch_id}"
        if not notes.done("_rows", batch_id):
            batch.write.mode("overwrite").parquet(place)
            notes.note("_rows", batch_id)
        rows = session.read.schema(schema).parquet(place)
        failed = None
        for name, writer in writers.items():
            if notes.done(name, batch_id):
                continue
            try:
                writer(rows, batch_id)
            except Exception as error:  # noqa: BLE001 - raised below, after the other writers had their turn
                failed = failed or error
            else:
                notes.note(name, batch_id)
        if failed is not None:
            raise failed

    drain_batches(stream, write, folder, "append")
