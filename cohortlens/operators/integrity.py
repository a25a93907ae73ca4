"""Row reconciliation, orphans, and key violations between tables.

Spark does not enforce keys, so these report what a constraint would have refused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ordering import ascending
from cohortlens.sources.schemas import WITHDRAWN, Reference, TableSpec


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_reconcile(tables: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Per (name, raw, cleaned): the row counts of both. ``raw`` comes with its filter applied."""
    counts = [
        df.agg(F.count("*").alias("zeilen")).select(
            F.lit(name).alias("tabelle"), F.lit(side).alias("seite"), "zeilen"
        )
        for name, raw, cleaned in tables
        for side, df in (("raw", raw), ("cleaned", cleaned))
    ]
    return (
        union_all(counts)
        .groupBy("tabelle")
        .agg(
            *[
                F.max(F.when(F.col("seite") == side, F.col("zeilen"))).alias(f"{side}_zeilen")
                for side in ("raw", "cleaned")
            ]
        )
    )


def orphan_keys(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``child`` without a row in ``parent``, and how many child rows have each.

    Child rows are counted per key before the join: the join then moves one row per key and task
    instead of one per event, however often a single key occurs. A NULL in a key passes.
    """
    complete = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    counted = child.where(complete).groupBy(*keys).agg(F.count("*").alias("anzahl"))
    return counted.join(parent.select(*keys), list(keys), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of child rows without a parent."""
    missing = orphan_keys(child, parent, keys)
    return missing.agg(F.coalesce(F.sum("anzahl"), F.lit(0)).alias("waisen"))


def fk_violations(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """One row per reference: child, parent and number of orphaned child rows."""
    return union_all(
        [
            orphans(tables[ref.child], tables[ref.parent], ref.keys).select(
                F.lit(ref.name).alias("beziehung"),
                F.lit(ref.child).alias("kind"),
                F.lit(ref.parent).alias("eltern"),
                "waisen",
            )
            for ref in references
        ]
    )


def pk_violations(tables: Mapping[str, DataFrame], specs: Sequence[TableSpec]) -> DataFrame:
    """One row per table with a key: repeated keys, and rows with a NULL in the key."""

    def check(spec: TableSpec) -> DataFrame:
        some_null = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in spec.key])
        per_key = tables[spec.name].groupBy(*spec.key).agg(F.count("*").alias("anzahl"))
        return per_key.agg(
            F.count_if(~some_null & (F.col("anzahl") > 1)).alias("doppelte_schluessel"),
            F.coalesce(F.sum(F.when(some_null, F.col("anzahl"))), F.lit(0)).alias("null_schluessel"),
        ).select(F.lit(spec.name).alias("tabelle"), "doppelte_schluessel", "null_schluessel")

    return union_all([check(spec) for spec in specs if spec.key])


def weight_sum_check(assessments: DataFrame, counted: Sequence[str] = ("TMA", "CMA")) -> DataFrame:
    """Weight of the coursework per presentation, and whether it adds up to 100."""
    weight = F.sum(F.when(F.col("assessment_type").isin(*counted), F.col("weight")))
    return (
        assessments.groupBy("code_module", "code_presentation")
        .agg(F.coalesce(weight, F.lit(0)).cast("double").alias("gewicht"))
        .withColumn("vollstaendig", F.when(F.col("gewicht") == 100, 1).otherwise(0))
        .orderBy(*ascending("code_module", "code_presentation"))
    )


def unregistration_check(
    registrations: DataFrame, enrolments: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Per module: unregistration dates without a withdrawal, and withdrawals without a date."""
    joined = registrations.join(enrolments.select(*keys, "final_result"), list(keys))
    has_date = F.col("date_unregistration").isNotNull()
    withdrew = F.col("final_result").eqNullSafe(WITHDRAWN)
    return (
        joined.groupBy("code_module")
        .agg(
            F.count_if(has_date & ~withdrew).alias("datum_ohne_abbruch"),
            F.count_if(~has_date & withdrew).alias("abbruch_ohne_datum"),
        )
        .orderBy(*ascending("code_module"))
    )


def score_domain_check(
    submissions: DataFrame, lowest: int = 0, highest: int = 100, pass_mark: int = 40
) -> DataFrame:
    """Submissions, scores out of range, scores below the pass mark, and flags other than 0 and 1."""
    score = F.col("score")
    return submissions.agg(
        F.count("*").alias("abgaben"),
        F.count_if(~score.between(lowest, highest)).alias("score_ausserhalb"),
        F.count_if(score < pass_mark).alias("score_nicht_bestanden"),
        F.count_if(~F.col("is_banked").isin(0, 1)).alias("is_banked_ausserhalb"),
    )
