"""Typed and raw tables as Parquet tables of the three databases raw, cleaned and analytics."""

from __future__ import annotations

from collections.abc import Callable, Mapping
import os

from pyspark.sql import DataFrame, SparkSession

DATABASES = ("raw", "cleaned", "analytics")


def create_databases(spark: SparkSession, root: str) -> None:
    for name in DATABASES:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{os.path.join(root, name)}'")


def rebuild_database(spark: SparkSession, name: str, root: str) -> None:
    """Drop the database with everything in it and create it empty."""
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{os.path.join(root, name)}'")


def write_tables(
    tables: Mapping[str, DataFrame], database: str, partition_by: Mapping[str, str] | None = None
) -> None:
    """Each DataFrame as a Parquet table, replacing an earlier one.

    ``partition_by`` names one column per table to lay it out by, such as the module of the click
    table, so that later module filters prune whole folders.
    """
    partition_by = partition_by or {}
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.saveAsTable(f"{database}.{name}")


def read_tables(spark: SparkSession, database: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in names}


def store(
    tables: Mapping[str, DataFrame], root: str, partition_by: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Each DataFrame as a Parquet folder under ``root``, and the stored tables.

    The same layout as ``write_tables`` without a catalog.
    """
    partition_by = partition_by or {}
    stored = {}
    for name, df in tables.items():
        path = os.path.join(root, name)
        writer = df.write.mode("errorifexists")
        if name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(path)
        stored[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored


def create_view(spark: SparkSession, name: str, define: Callable[[], DataFrame]) -> DataFrame:
    """(Re)create the temporary view ``name``; reading it computes it again each time."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    df = define()
    df.createOrReplaceTempView(name)
    return df
