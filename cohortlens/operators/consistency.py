"""Is an assessment passed as often as the others? Tests of homogeneity from one table of counts.

The submissions are counted once per assessment, in the map stage first; everything else works on a row per
assessment. For a two-by-two table (passed or not, one assessment or the other) and for all assessments of
a course the figures are Pearson's chi-square, its degrees of freedom and Cramér's V.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ordering import ascending
from cohortlens.session import cut_lineage
from cohortlens.sources.schemas import COURSE

#: Pass mark of a score, and the 5 % point of chi-square with one degree of freedom.
PASS_MARK = 40
CRITICAL = 3.841459

#: Pairs made and sorted in one task.
TASK_PAIRS = 500_000


def pass_counts(
    submissions: DataFrame, assessments: DataFrame, keys: Sequence[str] = COURSE, pass_mark: int = PASS_MARK
) -> DataFrame:
    """Per assessment with its course: scored submissions ``n`` and passed ones. Missing scores count for neither."""
    counted = (
        submissions.where(F.col("score").isNotNull())
        .groupBy("id_assessment")
        .agg(F.count("*").alias("n"), F.count_if(F.col("score") >= pass_mark).alias("bestanden"))
    )
    return assessments.select(*keys, "id_assessment").join(counted, "id_assessment")


def expected_gap(n: Column, passed: Column, all_n: Column, all_passed: Column) -> Column:
    """One row's part of chi-square; 0 where everybody or nobody passed."""
    share = all_passed.cast("double") / all_n
    spread = share * (1 - share)
    return F.when(spread > 0, F.pow(passed - n * share, F.lit(2)) / (n * spread)).otherwise(0.0)


def cramers_v(chi_square: Column, n: Column) -> Column:
    """For tables with two columns, or two rows."""
    return F.sqrt(chi_square / n)


def pair_consistency(counts: DataFrame, keys: Sequence[str] = COURSE, digits: int = 6) -> DataFrame:
    """Per pair of assessments of one course: chi-square, Cramér's V, and whether their pass rates differ.

    The pairs are those of a course, so they grow as the square of its assessments. ``counts`` is stored, and
    the assessments, not their pairs, are dealt out in the order of the result, to as many tasks as there are
    portions of ``TASK_PAIRS`` pairs: with ``b`` broadcast, each task makes and sorts its own pairs, and none
    is shuffled. If ``b`` is too long for a broadcast Spark joins and sorts as it sees fit. Pairs of which
    all or none passed have 0.
    """
    counts = cut_lineage(counts)
    per_course = counts.groupBy(*keys).agg(F.count("*").alias("m"))
    n_pairs = per_course.agg(F.sum(F.expr("m * (m - 1) / 2"))).first()[0] or 0
    a = (
        counts.select(*keys, F.col("id_assessment").alias("a"), F.col("n").alias("n_a"), F.col("bestanden").alias("b_a"))
        .repartitionByRange(1 + int(n_pairs) // TASK_PAIRS, *ascending(*keys, "a"))
    )
    b = counts.select(*keys, F.col("id_assessment").alias("b"), F.col("n").alias("n_b"), F.col("bestanden").alias("b_b"))
    n, passed = F.col("n_a") + F.col("n_b"), F.col("b_a") + F.col("b_b")
    chi = expected_gap(F.col("n_a"), F.col("b_a"), n, passed) + expected_gap(F.col("n_b"), F.col("b_b"), n, passed)
    return (
        a.join(b, list(keys))
        .where("a < b")
        .select(*keys, "a", "b", n.alias("abgaben"), chi.alias("chi"))
        .select(
            *keys,
            F.col("a").alias("pruefung_a"),
            F.col("b").alias("pruefung_b"),
            "abgaben",
            F.round("chi", digits).alias("chi_quadrat"),
            F.round(cramers_v(F.col("chi"), F.col("abgaben")), digits).alias("cramers_v"),
            F.when(F.col("chi") > CRITICAL, 1).otherwise(0).alias("auffaellig"),
        )
        .orderBy(*ascending(*keys, "pruefung_a", "pruefung_b"))
    )


def group_consistency(counts: DataFrame, group: str = "code_module", digits: int = 6) -> DataFrame:
    """Per group: its assessments, chi-square over all of them, degrees of freedom and Cramér's V."""
    totals = counts.groupBy(group).agg(F.sum("n").alias("all_n"), F.sum("bestanden").alias("all_passed"))
    part = expected_gap(F.col("n"), F.col("bestanden"), F.col("all_n"), F.col("all_passed"))
    return (
        counts.join(totals, group)
        .groupBy(group)
        .agg(F.count("*").alias("pruefungen"), F.max("all_n").alias("abgaben"), F.sum(part).alias("chi"))
        .select(
            group,
            "pruefungen",
            "abgaben",
            F.round("chi", digits).alias("chi_quadrat"),
            (F.col("pruefungen") - 1).alias("freiheitsgrade"),
            F.round(cramers_v(F.col("chi"), F.col("abgaben")), digits).alias("cramers_v"),
        )
        .orderBy(*ascending(group))
    )
