"""CSV in and out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.sources.schemas import RAW_FILES, TABLES, text_schema

# An unquoted empty field is NULL, a quoted one is the empty string, and quotes are doubled.
# NULL gets a marker no file contains, so that only a truly absent value becomes NULL.
NO_SUCH_TEXT = "\u0002"


def load_text_csv(
    spark: SparkSession, path: str, columns: list[str], quoted_newlines: bool = False
) -> DataFrame:
    """A CSV file or folder as all-text columns; a malformed row fails the job.

    ``quoted_newlines`` allows line breaks inside quotes, at the price that Spark cannot split the
    file, so leave it off for large files that have none.
    """
    return (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", quoted_newlines)
        .option("mode", "FAILFAST")
        .option("nullValue", NO_SUCH_TEXT)
        .option("emptyValue", "")
        .csv(path)
    )


def load_raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven raw tables from their CSV files in ``folder``."""
    return {
        name: load_text_csv(spark, os.path.join(folder, file), TABLES[name].names)
        for name, file in RAW_FILES.items()
    }


def export_csv(df: DataFrame, path: str) -> str:
    """Write ``df`` as a folder of CSV files with headers, NULL unquoted and empty text quoted."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", None)
        .option("emptyValue", '""')
        .csv(path)
    )
    return path


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported table back with its types."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
