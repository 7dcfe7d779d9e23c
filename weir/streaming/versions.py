"""Tables kept as one folder per micro-batch.

Batch n reads version n - 1 and overwrites version n, so a batch that is
repeated after a failure starts from the same state and leaves the same files.
Versions older than the last committed batch are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionedTable:
    def __init__(self, folder: str, schema: T.StructType) -> None:
        self.folder, self.schema = folder, schema

    def path(self, version: int) -> str:
        return f"{self.folder}/batch_id={version}"

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """Rows of a version; no rows before the first batch."""
        if version < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path(version))

    def write(self, df: DataFrame, version: int) -> DataFrame:
        df.select(*self.schema.names).write.mode("overwrite").parquet(self.path(version))
        return df.sparkSession.read.schema(self.schema).parquet(self.path(version))

    def all(self, spark: SparkSession) -> DataFrame:
        """All versions with their ``batch_id``."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch_id", T.IntegerType())])
        return spark.read.schema(schema).parquet(self.folder)
