"""A stored result that a refresh rewrites only where its source changed.

The result is stored in one folder per group (a module) and version. A manifest lists, per group, the
digest of the source rows it was computed from and its folder. A refresh computes the digests anew in one
aggregation per source, rebuilds the groups whose digest differs, writes them to new folders and then
lets the manifest's table point to the new manifest. That switch is one catalog call: a reader sees the
old list of folders or the new one, never a mix, and the folders of the old list stay in place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.sized import MAX_ROWS
from cohortlens.operators.integrity import union_all
from cohortlens.operators.report import check_key, point_to

MANIFEST = "gruppe string, fingerabdruck string, ordner string, neu boolean"

Sources = Mapping[str, DataFrame]


class TooManyGroups(ValueError):
    """A manifest is read by the driver, so its length is bounded."""


def source_digests(sources: Sources, group: str) -> DataFrame:
    """Per group (as text) the digest of its rows in all sources, whatever their order.

    Rows count, repeated ones each: number, sum and exclusive-or of 64-bit row hashes. Each source is
    read once and combined in the map stage.
    """
    parts = []
    for name in sorted(sources):
        row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(sources[name].columns)])
        per_group = sources[name].groupBy(F.col(group).cast("string").alias("gruppe")).agg(
            F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")
        )
        parts.append(per_group.select("gruppe", F.concat_ws(":", F.lit(name), "n", "s", "x").alias("part")))
    return (
        union_all(parts)
        .groupBy("gruppe")
        .agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("part"))), 256).alias("fingerabdruck"))
    )


def in_groups(df: DataFrame, group: str, groups: Sequence[str | None]) -> DataFrame:
    """Rows of the groups; NULL is a group. As a plain list of values it prunes folders."""
    named = [g for g in groups if g is not None]
    test = F.col(group).cast("string").isin(named) if named else F.lit(False)
    return df.where(test | F.col(group).isNull()) if None in groups else df.where(test)


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """The stored manifest; empty before the first refresh."""
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], MANIFEST)


def few(df: DataFrame) -> list:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise TooManyGroups(f"more than {MAX_ROWS} groups")
    return rows


def write_groups(df: DataFrame, folder: str, group: str, groups: Sequence[str | None], keys: Sequence[str]) -> dict:
    """Each group's rows in a folder of its own below a new version's folder: group -> folder."""
    spark = df.sparkSession
    path = os.path.join(folder, f"version-{uuid.uuid4().hex}")
    numbers = spark.createDataFrame([(g, k) for k, g in enumerate(groups)], "gruppe string, teil int")
    numbered = df.join(F.broadcast(numbers), F.col(group).cast("string").eqNullSafe(F.col("gruppe"))).drop("gruppe")
    numbered.write.mode("errorifexists").partitionBy("teil").parquet(path)
    written = spark.read.schema(numbered.schema).parquet(path)
    check_key(written, keys)
    present = {row["teil"] for row in written.select("teil").distinct().collect()}
    return {g: os.path.join(path, f"teil={k}") if k in present else None for k, g in enumerate(groups)}


def refresh_changed(
    sources: Sources,
    build: Callable[[Sources], DataFrame],
    table: str,
    folder: str,
    group: str,
    keys: Sequence[str],
) -> DataFrame:
    """Bring the stored result up to date; returns the new manifest.

    ``build`` computes the result from the sources and must treat groups apart; it gets the sources cut
    down to the groups that changed, are new or lost all rows of one source. Groups no source has any more
    leave the manifest. ``neu`` says which folders this refresh wrote. Up to ``MAX_ROWS`` groups.
    """
    spark = next(iter(sources.values())).sparkSession
    old = {row["gruppe"]: row for row in few(manifest(spark, table))}
    now = {row["gruppe"]: row["fingerabdruck"] for row in few(source_digests(sources, group))}
    changed = sorted(
        (g for g, digest in now.items() if g not in old or old[g]["fingerabdruck"] != digest), key=lambda g: (g is not None, g or "")
    )
    written = {}
    if changed:
        cut = {name: in_groups(df, group, changed) for name, df in sources.items()}
        written = write_groups(build(cut), folder, group, changed, keys)
    rows = [
        (g, digest, written[g] if g in written else old[g]["ordner"], g in written)
        for g, digest in sorted(now.items(), key=lambda item: (item[0] is not None, item[0] or ""))
    ]
    path = os.path.join(folder, f"manifest-{uuid.uuid4().hex}")
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(path)
    if spark.catalog.tableExists(table):
        return point_to(spark, table, path)
    spark.catalog.createTable(table, path=path, source="parquet")
    return spark.table(table)


def read_groups(listed: DataFrame, like: DataFrame) -> DataFrame:
    """The stored result of a manifest, with the columns of ``like``."""
    spark = listed.sparkSession
    folders = [row["ordner"] for row in few(listed.where("ordner IS NOT NULL"))]
    if not folders:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(*folders).select(*like.columns)
