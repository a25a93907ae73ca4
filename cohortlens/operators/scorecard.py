"""Scorecard of groups: metrics graded against thresholds, with a verdict per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ordering import ascending


@dataclass(frozen=True)
class Grading:
    """Grades of one metric: the first rule that holds, else ``otherwise``.

    Rules are (operator, value, grade) with one of ``>=``, ``<=`` and ``==``.
    """

    metric: str
    name: str
    rules: tuple[tuple[str, float, str], ...]
    otherwise: str = "-"

    def column(self) -> Column:
        grade = F.lit(self.otherwise)
        for operator, value, given in reversed(self.rules):
            metric = F.col(self.metric)
            holds = {">=": metric >= value, "<=": metric <= value, "==": metric == value}[operator]
            grade = F.when(holds, given).otherwise(grade)
        return grade.alias(self.name)


# The published thresholds.
GRADINGS = (
    Grading("gruppengroesse", "gruppengroesse", ((">=", 2000, "+"),)),
    Grading("anzahl_praesentationen", "praesentationen", ((">=", 3, "+"),), "o"),
    Grading("score_streuung", "score_streuung", ((">=", 20, "+"), (">=", 17, "o"))),
    Grading("anzahl_activity_types", "activity_vielfalt", ((">=", 15, "+"), (">=", 10, "o"))),
    Grading("disability_faelle", "disability_faelle", ((">=", 700, "+"), (">=", 350, "o"))),
    Grading("fehlende_imd_werte", "imd_vollstaendigkeit", (("<=", 100, "+"), ("<=", 300, "o"))),
    Grading("anzahl_ergebnistypen", "ergebnistypen", (("==", 4, "+"),)),
)


def group_metrics(enrolments: DataFrame, group: str, missing: Column) -> DataFrame:
    """Persons, presentations, flagged rows, missing bands and result types per group."""
    return enrolments.groupBy(group).agg(
        F.count_distinct("id_student").alias("gruppengroesse"),
        F.count_distinct("code_presentation").alias("anzahl_praesentationen"),
        F.count_if(F.col("disability") == "Y").alias("disability_faelle"),
        F.count_if(missing).alias("fehlende_imd_werte"),
        F.count_distinct("final_result").alias("anzahl_ergebnistypen"),
    )


def group_scorecard(
    metrics: Sequence[DataFrame],
    key: str,
    gradings: Sequence[Grading] = GRADINGS,
    verdicts: Mapping[str, str] | None = None,
    first: Sequence[str] = (),
) -> DataFrame:
    """One row per group present in every metric table, the ``first`` groups on top."""
    joined = reduce(lambda a, b: a.join(b, key), metrics)
    verdict = F.lit("")
    for group, text in (verdicts or {}).items():
        verdict = F.when(F.col(key) == group, text).otherwise(verdict)
    later = F.when(F.col(key).isin(*first), 0).otherwise(1) if first else F.lit(1)
    return (
        joined.select(
            key, *[grading.column() for grading in gradings], verdict.alias("entscheidung")
        )
        .orderBy(later, *ascending(key))
    )
