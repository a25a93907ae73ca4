"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import io
import os
from pathlib import Path
from zipfile import ZipFile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import scratch_path

#: Applications that have been sent this package's code.
SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they inherit a path to it or have it installed."""
    home = Path(__file__).resolve().parents[2]
    inherited = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    application = spark.sparkContext.applicationId
    if "site-packages" in home.parts or str(home) in map(os.path.realpath, inherited) or application in SHIPPED:
        return
    zipped = io.BytesIO()
    with ZipFile(zipped, "w") as archive:
        for module in sorted(home.joinpath("cohortlens").rglob("*.py")):
            archive.write(module, module.relative_to(home))
    folder = scratch_path(spark, "code")
    system, path = open_folder(folder)
    with system.open_output_stream(f"{path}/cohortlens.zip") as stream:
        stream.write(zipped.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/cohortlens.zip")
    SHIPPED.add(application)


#: Rows of whole texts that go to a Python task at once.
ROWS_AT_ONCE = 1000


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Python tasks on whole texts: code on the workers, and small batches.

    Spark bounds an Arrow batch by rows only; ten thousand long texts are more than a worker should hold.
    A smaller bound that is set already stays.
    """
    ship_code(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS_AT_ONCE:
        spark.conf.set(setting, ROWS_AT_ONCE)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, for operators whose Python tasks work on whole texts."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns added beside them cannot clash with their names."""
    return F.struct(*(F.col(f"`{name}`") for name in docs.columns))


#: Longer keys are computed each time, so that the size of a cache stays bounded.
LONGEST_KEY = 64


class TwoGenerations(dict):
    """A bounded cache: ``self[key]`` computes a missing value with ``compute``.

    When ``limit`` keys are held, the held ones become the old generation and the cache starts anew;
    old keys that are asked for again come back. So words in steady use stay, at most twice
    ``limit`` values are held, and nothing is scanned to evict.
    """

    def __init__(self, compute, limit: int = 1 << 18) -> None:
        super().__init__()
        self.compute = compute
        self.limit = limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= LONGEST_KEY:
            self[key] = value
        return value


#: What this worker process keeps from task to task, by operator; only ``kept_for`` names it.
KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What ``operator`` keeps in this worker process, empty at first.

    Workers pass from one operator to the next, so what others kept is let go: it would only add up.
    """
    if operator not in KEPT:
        KEPT.clear()
        KEPT[operator] = {}
        pa.default_memory_pool().release_unused()
    return KEPT[operator]


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it, for files that tasks write."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path
