"""Group sizes and shares.

Everything here counts once and then works on the counts. The total of a group is summed from its
counts and joined back, rather than taken in a window over the group: a category column may have
many values, and a window would hold all of a group's in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import percent
from cohortlens.functions.ordering import ascending, rank_of


def enrolments_vs_persons(df: DataFrame, group: str, person: str) -> DataFrame:
    """Rows and distinct persons per group."""
    return (
        df.groupBy(group)
        .agg(
            F.count("*").alias("einschreibungen"),
            F.count_distinct(person).alias("personen"),
        )
        .orderBy(*ascending(group))
    )


def repeat_surplus(df: DataFrame, group: str, person: str) -> DataFrame:
    """Enrolments beyond the first of each person, per group."""
    return enrolments_vs_persons(df, group, person).select(
        group, (F.col("einschreibungen") - F.col("personen")).alias("mehrfach")
    )


def repeat_enrolments(df: DataFrame, group: str, person: str, n: int | None = None) -> DataFrame:
    """Persons with more than one enrolment in a group, or the first ``n`` by group and person."""
    repeated = (
        df.groupBy(group, person)
        .agg(F.count("*").alias("n_praesentationen"))
        .where(F.col("n_praesentationen") > 1)
        .orderBy(*ascending(group, person))
    )
    return repeated if n is None else repeated.limit(n)


def enrolment_lookup(df: DataFrame, persons: Sequence[int], module: str) -> DataFrame:
    """The enrolments of the listed persons in one module."""
    return (
        df.where(F.col("id_student").isin(*persons) & (F.col("code_module") == module))
        .select(
            "code_module", "code_presentation", "id_student", "final_result", "num_of_prev_attempts"
        )
        .orderBy(*ascending("id_student", "code_presentation"))
    )


def with_group_total(df: DataFrame, group: str, value: str, total: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its group as ``total``. NULL is a group of its own."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(total))
    return df.join(totals, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def share_within_group(df: DataFrame, group: str, category: str) -> DataFrame:
    """Rows per category and their share of the group in percent."""
    counted = df.groupBy(group, category).agg(F.count("*").alias("anzahl"))
    return (
        with_group_total(counted, group, "anzahl", "gesamt")
        .select(group, category, "anzahl", percent(F.col("anzahl"), F.col("gesamt")).alias("prozent"))
        .orderBy(*ascending(group, category))
    )


def labelled(df: DataFrame, category: str, null_label: str | None, order: Sequence[str] | None) -> DataFrame:
    """Sort by category, in ``order`` if given (unlisted ones last), and name the NULL category."""
    keys = ascending(category)
    if order is not None:
        keys = [rank_of(F.col(category), order).asc_nulls_last(), *keys]
    ordered = df.orderBy(*keys)
    if null_label is None:
        return ordered
    return ordered.withColumn(category, F.coalesce(category, F.lit(null_label)))


def side_by_side_share(
    df: DataFrame,
    category: str,
    modules: Sequence[str],
    null_label: str | None = None,
    order: Sequence[str] | None = None,
    counts: bool = True,
) -> DataFrame:
    """Per category, the rows of each module and their share of the whole module.

    One column pair per module, only the percentages without ``counts``. A module without any rows
    has NULL percentages.
    """
    counted = df.groupBy(category).agg(
        *[F.count_if(F.col("code_module") == m).alias(f"{m.lower()}_anzahl") for m in modules]
    )

    def share(module: str) -> list[Column]:
        n = f"{module.lower()}_anzahl"
        total = counted.agg(F.sum(n)).scalar()
        pct = percent(F.col(n), total).alias(f"{module.lower()}_prozent")
        return [F.col(n), pct] if counts else [pct]

    shares = counted.select(category, *[column for m in modules for column in share(m)])
    return labelled(shares, category, null_label, order)


def conditional_share(df: DataFrame, by: str, condition: Column, name: str) -> DataFrame:
    """Rows per non-NULL category and the percentage that meets the condition."""
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count("*").alias("anzahl"),
            percent(F.count_if(condition), F.count("*")).alias(name),
        )
        .orderBy(*ascending(by))
    )


def flag_share(df: DataFrame, by: str, flag: str, value: str = "Y") -> DataFrame:
    """Rows, flagged rows and their percentage per group."""
    flagged = F.count_if(F.col(flag) == value)
    return (
        df.groupBy(by)
        .agg(
            F.count("*").alias("einschreibungen"),
            flagged.alias(f"mit_{flag}"),
            percent(flagged, F.count("*")).alias(f"prozent_{flag}"),
        )
        .orderBy(*ascending(by))
    )
