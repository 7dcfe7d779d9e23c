"""Session settings and shared folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that can change on a running session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state beyond an executor's heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Checkpoint files go when the frames that use them are gone.
START_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def build_session(app: str = "weir", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; cluster settings (master, memory, folders) stay with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A machine-local folder is used only when the session runs in one process
    and names no folder (tests, laptops).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    base = os.path.join(tempfile.gettempdir(), "weir-" + uuid.uuid4().hex)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write a result once to the checkpoint folder and read it from there.

    For results that a plan uses several times or that must not be evaluated
    twice. The files outlive lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one streaming run (sink files and offsets)."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
