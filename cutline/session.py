"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "cutline", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or get) a session with the defaults; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read: ``spark.checkpoint.dir``.

    A machine-local folder is only made up for a local master, where driver and
    executors are one process; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="cutline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much CPU each, such as whole texts.

    It is read as it is, so no shuffle moves the texts. A caller whose table is one row group,
    and so one task, asks for a number of partitions by ``spark.cutline.textPartitions``.
    """
    wanted = spark.conf.get("spark.cutline.textPartitions", None)
    df = table(spark, sf_dir, name)
    return df.repartition(int(wanted)) if wanted else df


TASKS_PER_CORE = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows whose work costs much CPU each, dealt by key over all cores before that work.

    A table of one row group is one task however many rows it holds; the rows are shuffled while they are narrow.
    The number is given, so that no step merges the parts again for being few bytes.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts end after ``TEXT_BATCH_BYTES``, unless the session has a limit of its own.

    Batches are else cut by rows alone: 10,000 long texts are one buffer outside the heap of an executor, twice
    that while it grows, and as much again in the worker.
    """
    if spark.conf.get(ARROW_BYTES, None) in (None, str(2**31 - 1)):
        spark.conf.set(ARROW_BYTES, str(TEXT_BATCH_BYTES))


def epoch_seconds(col: str):
    """Whole seconds since 1970 of a zone-less timestamp column, whatever the session time zone."""
    from pyspark.sql import functions as F

    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
