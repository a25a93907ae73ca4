"""The report with one row per enrolment, and its stored copy."""

from __future__ import annotations

from collections.abc import Sequence
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numeric import mean_of, rounded
from cohortlens.functions.ordering import ascending
from cohortlens.functions.sized import small_side
from cohortlens.operators.audit import duplicate_keys
from cohortlens.operators.rates import Outcome
from cohortlens.session import cut_lineage
from cohortlens.sources.schemas import ENROLMENT

PERSON_COLUMNS = (
    "gender",
    "age_band",
    "imd_band",
    "highest_education",
    "disability",
    "final_result",
)


def report_base(
    enrolments: DataFrame,
    clicks: DataFrame,
    submitted: DataFrame,
    keys: Sequence[str] = ENROLMENT,
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """Every enrolment with its clicks, active days and submissions, 0 where it has none."""
    zero_filled = ("klicks_gesamt", "aktive_tage", "abgaben")
    return (
        enrolments.select(*keys, *PERSON_COLUMNS)
        .join(clicks, list(keys), "left")
        .join(submitted, list(keys), "left")
        .select(
            "id_student",
            "code_module",
            "code_presentation",
            *PERSON_COLUMNS,
            F.when(outcome.succeeded, 1).otherwise(0).alias("bestanden"),
            *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in zero_filled],
            "score_durchschnitt",
        )
    )


def with_deviation(
    base: DataFrame, means: DataFrame, group: str, value: str, name: str
) -> DataFrame:
    """``base`` with the distance of ``value`` from its group's mean in ``means``.

    A window over the group would put every enrolment of a module into one task, so the means are
    joined back instead. Plain equality (a module is part of the key and never NULL) lets Spark drop the
    join for readers who do not ask for the deviation.
    """
    deviation = F.col(value).cast("decimal(20,0)") - F.col("_mean")
    return (
        base.join(means, F.col(group) == F.col("_group"), "left")
        .withColumn(name, rounded(deviation, 1))
        .drop("_group", "_mean")
    )


def group_means(base: DataFrame, group: str, value: str) -> DataFrame:
    return base.groupBy(F.col(group).alias("_group")).agg(mean_of(F.col(value)).alias("_mean"))


def report_view(
    enrolments: DataFrame,
    clicks: DataFrame,
    submitted: DataFrame,
    keys: Sequence[str] = ENROLMENT,
    group: str = "code_module",
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """The report as a view: computed again on each read, and only as far as the reader needs it.

    Reading the deviation computes the clicks twice, once for the means; to store the report, use
    ``enrolment_report``.
    """
    base = report_base(enrolments, clicks, submitted, keys, outcome)
    means = group_means(base, group, "klicks_gesamt")
    return with_deviation(base, means, group, "klicks_gesamt", "klicks_diff_vom_modulschnitt")


def enrolment_report(
    enrolments: DataFrame,
    clicks: DataFrame,
    submitted: DataFrame,
    keys: Sequence[str] = ENROLMENT,
    group: str = "code_module",
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """The report from a base that is computed once, into the shared folder.

    The click table is read once, the means come from the stored base, and next to them the
    enrolments are not shuffled by module.
    """
    base = cut_lineage(report_base(enrolments, clicks, submitted, keys, outcome))
    means = small_side(group_means(base, group, "klicks_gesamt"))
    return with_deviation(base, means, group, "klicks_gesamt", "klicks_diff_vom_modulschnitt")


def report_counts(report: DataFrame, group: str = "code_module") -> DataFrame:
    """Rows and rows without clicks per group."""
    return (
        report.groupBy(group)
        .agg(
            F.count("*").alias("zeilen"),
            F.count_if(F.col("klicks_gesamt") == 0).alias("ohne_klicks"),
        )
        .orderBy(*ascending(group))
    )


def mean_clicks(report: DataFrame, group: str = "code_module") -> DataFrame:
    """Mean clicks per enrolment and group."""
    return (
        report.groupBy(group)
        .agg(rounded(mean_of(F.col("klicks_gesamt")), 1).alias("klicks_schnitt"))
        .orderBy(*ascending(group))
    )


def report_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in one of two tables: distinct ones, and counting repetitions.

    Both rows are grouped to a signed count per distinct row, so that each table is read and
    shuffled once for all four numbers.
    """
    columns = left.columns
    tagged = (
        left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionAll(right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*columns)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    l, r = F.col("l"), F.col("r")
    surplus = [F.greatest(a - b, F.lit(0)) for a, b in ((l, r), (r, l))]
    return tagged.agg(
        F.count_if(r == 0).alias("nur_links"),
        F.count_if(l == 0).alias("nur_rechts"),
        F.coalesce(F.sum(surplus[0]), F.lit(0)).alias("nur_links_mehrfach"),
        F.coalesce(F.sum(surplus[1]), F.lit(0)).alias("nur_rechts_mehrfach"),
    )


class KeyViolation(ValueError):
    """The stored copy would have two rows for one key."""


def check_key(df: DataFrame, keys: Sequence[str]) -> None:
    repeated = duplicate_keys(df, keys).limit(1).collect()
    if repeated:
        raise KeyViolation(f"repeated key {repeated[0].asDict()}")


def write_version(df: DataFrame, folder: str, keys: Sequence[str]) -> str:
    """Write ``df`` to a new sub-folder and check its key on the stored rows."""
    path = os.path.join(folder, f"version-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    check_key(df.sparkSession.read.parquet(path), keys)
    return path


def materialise(
    df: DataFrame, table: str, folder: str, keys: Sequence[str] = ENROLMENT
) -> DataFrame:
    """Store ``df`` as the table ``table`` under ``folder``; a table of that name then reads it."""
    spark = df.sparkSession
    path = write_version(df, folder, keys)
    if spark.catalog.tableExists(table):
        return point_to(spark, table, path)
    spark.catalog.createTable(table, path=path, source="parquet")
    return spark.table(table)


def point_to(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Let ``table`` read from ``path`` from now on; it is never missing in between."""
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def refresh(df: DataFrame, table: str, folder: str, keys: Sequence[str] = ENROLMENT) -> DataFrame:
    """Store ``df`` as the new content of ``table``.

    The new version goes to a folder of its own and the table then points there; readers of the old
    version keep their files.
    """
    spark: SparkSession = df.sparkSession
    return point_to(spark, table, write_version(df, folder, keys))
