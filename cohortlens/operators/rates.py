"""Pass and withdrawal rates, over all enrolments and without the withdrawn ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import percent
from cohortlens.functions.ordering import ascending
from cohortlens.operators.shares import labelled
from cohortlens.sources.schemas import PASSED, WITHDRAWN


@dataclass(frozen=True)
class Outcome:
    """Which results count as success and which are left out of the second base."""

    column: str = "final_result"
    success: tuple[str, ...] = PASSED
    excluded: str = WITHDRAWN

    @property
    def succeeded(self) -> Column:
        return F.col(self.column).isin(*self.success)

    @property
    def withdrawn(self) -> Column:
        return F.col(self.column) == self.excluded

    @property
    def finished(self) -> Column:
        return F.col(self.column) != self.excluded


def outcome_rate(
    df: DataFrame, by: Sequence[str], outcome: Outcome = Outcome(), withdrawal: bool = False
) -> DataFrame:
    """Enrolments and pass rates on both bases per group, optionally with the withdrawal rate."""
    passed, finished = F.count_if(outcome.succeeded), F.count_if(outcome.finished)
    columns = [
        F.count("*").alias("einschreibungen"),
        percent(passed, F.count("*")).alias("bestanden_alle_prozent"),
        finished.alias("ohne_abbrecher"),
    ]
    if withdrawal:
        columns.append(
            percent(F.count_if(outcome.withdrawn), F.count("*")).alias("abbruch_prozent")
        )
    columns.append(percent(passed, finished).alias("bestanden_ohne_abbrecher_prozent"))
    return df.groupBy(*by).agg(*columns).orderBy(*ascending(*by))


def rate_gap(
    df: DataFrame, by: str, flag: str, yes: str = "Y", no: str = "N", outcome: Outcome = Outcome()
) -> DataFrame:
    """Percentage points between the pass rates of two flag groups: without minus with the flag.

    The rates are rounded before they are subtracted, as when reading them off the rate table.
    """
    rates = outcome_rate(df, [by, flag], outcome)

    def gap(rate: str) -> Column:
        rate_of = [F.max(F.when(F.col(flag) == value, F.col(rate))) for value in (no, yes)]
        return F.round(rate_of[0] - rate_of[1], 1)

    return (
        rates.groupBy(by)
        .agg(
            gap("bestanden_alle_prozent").alias("abstand_alle"),
            gap("bestanden_ohne_abbrecher_prozent").alias("abstand_ohne_abbrecher"),
        )
        .orderBy(*ascending(by))
    )


def side_by_side_rate(
    df: DataFrame,
    category: str,
    modules: Sequence[str],
    null_label: str | None = None,
    order: Sequence[str] | None = None,
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """Per category and module, the pass rate of all enrolments and of those not withdrawn."""

    def rates(module: str) -> list[Column]:
        here = F.col("code_module") == module
        passed = F.count_if(here & outcome.succeeded)
        return [
            percent(passed, F.count_if(here)).alias(f"{module.lower()}_alle"),
            percent(passed, F.count_if(here & outcome.finished)).alias(f"{module.lower()}_ohne"),
        ]

    table = df.groupBy(category).agg(*[column for m in modules for column in rates(m)])
    return labelled(table, category, null_label, order)


def side_by_side_withdrawal(
    df: DataFrame,
    category: str,
    modules: Sequence[str],
    null_label: str | None = None,
    order: Sequence[str] | None = None,
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """Per category and module, the withdrawal rate."""

    def rate(module: str) -> Column:
        here = F.col("code_module") == module
        return percent(F.count_if(here & outcome.withdrawn), F.count_if(here)).alias(
            f"{module.lower()}_abbruch"
        )

    table = df.groupBy(category).agg(*[rate(m) for m in modules])
    return labelled(table, category, null_label, order)


def band_gradient(
    df: DataFrame,
    band: str,
    first: str,
    last: str,
    by: str = "code_module",
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """Per group, pass and withdrawal rates of the first and the last band."""

    def rates(value: str, name: str) -> list[Column]:
        here = F.col(band) == value
        passed = F.count_if(here & outcome.succeeded)
        return [
            percent(passed, F.count_if(here)).alias(f"bestanden_alle_{name}"),
            percent(passed, F.count_if(here & outcome.finished)).alias(f"bestanden_ohne_{name}"),
            percent(F.count_if(here & outcome.withdrawn), F.count_if(here)).alias(f"abbruch_{name}"),
        ]

    return (
        df.where(F.col(band).isin(first, last))
        .groupBy(by)
        .agg(*rates(first, "erstes"), *rates(last, "letztes"))
        .orderBy(*ascending(by))
    )
