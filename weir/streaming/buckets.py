"""A keyed state table of which a micro-batch rewrites only the buckets it touches.

Rows are dealt into a fixed number of buckets by a hash of their key. Batch n writes the
new rows of the buckets it touched to ``data/v=n/bucket=b`` and a manifest that names,
for every bucket, the batch that wrote it last. A manifest has one row a bucket,
whatever the size of the state, so the driver may hold it. A batch that is repeated
after a failure starts from manifest n - 1 and overwrites its own files. Files that
none of the last ``keep`` manifests names are removed, manifests with them, so their number stays bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
MANIFEST = "bucket int, version int"


class BucketTable:
    def __init__(self, folder: str, schema: T.StructType, keys: Sequence[str | Column], buckets: int = BUCKETS, keep: int = 2) -> None:
        self.folder, self.schema, self.keys, self.buckets, self.keep = folder, schema, list(keys), buckets, keep

    def bucket_of(self, *keys: str | Column) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def touched(self, *bucket_columns: DataFrame) -> list[int]:
        """Distinct buckets of one-column frames: at most ``buckets`` numbers."""
        out: set[int] = set()
        for df in bucket_columns:
            out |= {r[0] for r in df.distinct().collect()}
        return sorted(out)

    def versions(self, spark: SparkSession, version: int) -> dict[int, int]:
        if version < 0:
            return {}
        rows = spark.read.schema(MANIFEST).json(f"{self.folder}/manifest/v={version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, spark: SparkSession, version: int, only: Sequence[int] | None = None) -> DataFrame:
        """Rows as of a batch, of all buckets or of those named."""
        named = self.versions(spark, version)
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(named.items()) if only is None or b in set(only)]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, only: Sequence[int], version: int) -> None:
        """Make ``rows`` the content of the named buckets; the other buckets stay as they are."""
        spark = rows.sparkSession
        named = {b: v for b, v in self.versions(spark, version - 1).items() if b not in set(only)}
        place = f"{self.folder}/data/v={version}"
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket_of())
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        named |= {b: version for b in only if _fs(spark, f"{place}/bucket={b}", "exists")}
        manifest = spark.createDataFrame(sorted(named.items()), MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.folder}/manifest/v={version}")
        self._clean(spark, version, named)

    def _clean(self, spark: SparkSession, version: int, named: dict[int, int]) -> None:
        """Drop what none of the last ``keep`` manifests names."""
        gone = version - self.keep
        if gone < 0:
            return
        kept = {*named.items()}.union(*[self.versions(spark, v).items() for v in range(gone + 1, version)])
        for b, v in set(self.versions(spark, gone).items()) - kept:
            _fs(spark, f"{self.folder}/data/v={v}/bucket={b}", "delete", True)
        _fs(spark, f"{self.folder}/manifest/v={gone}", "delete", True)


def _fs(spark: SparkSession, path: str, call: str, *more):
    """A file system call on a path, in whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(place.getFileSystem(spark._jsc.hadoopConfiguration()), call)(place, *more)
