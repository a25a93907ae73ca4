"""Session set-up for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "cohortlens", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        # Recording a Python stack trace per column expression slows building a query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a table, and of shuffled rows, that one task reads. A task that groups by nearly unique keys holds
#: up to 30 times that, since shuffled rows are compressed.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
}
BYTE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def byte_count(text: str) -> int:
    """Bytes of a size as Spark writes it: ``64MB``, ``16k``, ``134217728b``."""
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", text.strip().lower()).groups()
    return int(number) * BYTE_UNITS[unit if unit == "b" else unit.removesuffix("b")]


def bound_tasks(spark: SparkSession) -> None:
    """Let a task read at most ``TASK_BYTES``, unless the session has smaller bounds.

    Spark's own bounds (128 and 64 MB) let a task's hash tables grow with the input up to gigabytes. Only the
    number of tasks follows from this, never what they compute.
    """
    for key, most in TASK_BYTES.items():
        if byte_count(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return os.path.join(shared_folder(spark), f"cohortlens-{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet to the shared folder.

    For a result that several later steps read: they start from the stored rows, also after an
    executor was lost, instead of repeating the scans and joins behind them. Unlike a checkpoint, the
    files can be read by column and tell Spark their size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
