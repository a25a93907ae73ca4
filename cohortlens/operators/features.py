"""Model features: the model base, standardised activity, and the design matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ordering import ascending, mapped
from cohortlens.functions.sized import distinct_values, small_side
from cohortlens.operators.rates import Outcome
from cohortlens.session import cut_lineage
from cohortlens.sources.schemas import ENROLMENT, IMD_ORDER

# Recodings of the model.
IMD_RANKS = {band: rank for rank, band in enumerate(IMD_ORDER, 1)}
EDUCATION_LEVELS = {
    "No Formal quals": "unter_A_Level",
    "Lower Than A Level": "unter_A_Level",
    "A Level or Equivalent": "A_Level",
    "HE Qualification": "Studium",
    "Post Graduate Qualification": "Studium",
}
EDUCATION_REFERENCE = "unter_A_Level"
YOUNGEST = "0-35"
MODEL_COLUMNS = ("bestanden", "imd", "bildung", "alter_35plus", "disability_ja", "weiblich")


def model_base(
    enrolments: DataFrame,
    imd_ranks: Mapping[str, int] = IMD_RANKS,
    education: Mapping[str, str] = EDUCATION_LEVELS,
    outcome: Outcome = Outcome(),
) -> DataFrame:
    """The rows and recoded features of the models, from the report or the enrolments themselves.

    Withdrawn enrolments and rows without a band rank are left out. A missing result counts as not
    passed, a missing age as older, a missing flag as not set; an education that is not listed
    stays NULL and drops out with the design matrix.
    """
    result = F.col(outcome.column)
    return (
        enrolments.where(~result.eqNullSafe(outcome.excluded))
        .withColumns(
            {
                "bestanden": F.when(outcome.succeeded, 1).otherwise(0),
                "imd": mapped(F.col("imd_band"), dict(imd_ranks)),
                "bildung": mapped(F.col("highest_education"), dict(education)),
                "alter_35plus": (~F.col("age_band").eqNullSafe(YOUNGEST)).cast("int"),
                "disability_ja": F.col("disability").eqNullSafe("Y").cast("int"),
                "weiblich": F.col("gender").eqNullSafe("F").cast("int"),
            }
        )
        .dropna(subset=["imd"])
    )


def zscore_log1p(df: DataFrame, columns: Mapping[str, str], group: str = "code_module") -> DataFrame:
    """Add ln(1 + x), standardised within its group, per (result name, column).

    Mean and sample standard deviation of all columns come from one grouping and are joined back.
    NULL where a group has no spread. ``df`` is read twice, so hand in a stored one.
    """
    logs = {name: F.log1p(F.col(column).cast("double")) for name, column in columns.items()}
    stats = df.groupBy(F.col(group).alias("_group")).agg(
        *[F.avg(value).alias(f"_mean_{name}") for name, value in logs.items()],
        *[F.stddev_samp(value).alias(f"_std_{name}") for name, value in logs.items()],
    )
    joined = df.join(small_side(stats), F.col(group).eqNullSafe(F.col("_group")), "left")
    standardised = {
        name: (value - F.col(f"_mean_{name}")) / F.nullif(F.col(f"_std_{name}"), F.lit(0.0))
        for name, value in logs.items()
    }
    return joined.withColumns(standardised).select(*df.columns, *columns)


def with_activity(
    base: DataFrame, activity: DataFrame, columns: Sequence[str], keys: Sequence[str] = ENROLMENT
) -> DataFrame:
    """``base`` with activity columns of the same enrolment, 0 where it has none."""
    return base.join(activity.select(*keys, *columns), list(keys), "left").fillna(
        0, subset=list(columns)
    )


def model_features(
    base: DataFrame,
    activity: DataFrame,
    types: Sequence[str],
    group: str = "code_module",
    keys: Sequence[str] = ENROLMENT,
) -> DataFrame:
    """The model base with the standardised activity of all models.

    ``activity`` holds klicks_gesamt, klicks_frueh and a column per type. The joined table is stored
    once in the shared folder; group statistics, standardised columns and every pass of
    the model fits start from there.
    """
    clicks = ["klicks_gesamt", "klicks_frueh", *types]
    joined = cut_lineage(with_activity(base.select(*keys, *MODEL_COLUMNS), activity, clicks, keys))
    scores = {"klicks_z": "klicks_gesamt", "frueh_z": "klicks_frueh"}
    scores |= {f"{name}_z": name for name in types}
    return zscore_log1p(joined, scores, group)


@dataclass(frozen=True)
class Categorical:
    """A treatment-coded column: one 0/1 term per level except the reference."""

    column: str
    levels: tuple[str, ...]
    reference: str

    def term(self, level: str) -> str:
        return f"{self.column}={level}"

    @property
    def contrasts(self) -> list[str]:
        return [level for level in self.levels if level != self.reference]

    def columns(self) -> dict[str, Column]:
        known = F.col(self.column).isin(*self.levels)
        return {
            self.term(level): F.when(known, (F.col(self.column) == level).cast("double"))
            for level in self.contrasts
        }


def categorical(df: DataFrame, column: str, reference: str | None = None) -> Categorical:
    """The levels that occur in ``df``; the first one is the reference unless another is named."""
    levels = tuple(distinct_values(df, column))
    return Categorical(column, levels, levels[0] if reference is None else reference)


def design_columns(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[Categorical] = ()
) -> DataFrame:
    """The label and one double column per term, categorical terms first; NULL where a value is missing."""
    terms: dict[str, Column] = {}
    for factor in categorical:
        terms |= factor.columns()
    terms |= {name: F.col(name).cast("double") for name in numeric}
    return df.select(F.col(label).cast("double").alias(label), *[c.alias(name) for name, c in terms.items()])


def design_matrix(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[Categorical] = ()
) -> DataFrame:
    """``design_columns`` without rows with a NULL in any of them, such as a value that is no listed level."""
    return design_columns(df, label, numeric, categorical).dropna()


def group_mean(df: DataFrame, flag: str, value: str, digits: int = 2) -> DataFrame:
    """Mean of a standardised feature per subgroup."""
    return (
        df.groupBy(flag)
        .agg(F.count("*").alias("anzahl"), F.round(F.avg(value), digits).alias("mittelwert"))
        .orderBy(*ascending(flag))
    )
