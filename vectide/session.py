"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffle files of a query when the query has ended.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "vectide", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset so that the
    submit-time configuration decides; AQE then sizes the shuffles.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Write to a few partition folders at once instead of sorting whole rows first.
        "spark.sql.maxConcurrentOutputFileWriters": "32",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, because its one process sees that folder.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vectide-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path below the shared folder; never handed out twice."""
    return f"{shared_folder(spark)}/vectide/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and stays
    columnar, so later readers still prune columns and push filters down.
    Nothing reads the shuffles behind it again, so their files go at once
    instead of when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_deleted(spark):
        writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path  # for drop_scratch
    return written


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables that came from :func:`materialize` and that nothing will read again, not even a repeated task.

    Call it only when every reader's result has been written itself.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
