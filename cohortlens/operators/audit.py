"""Audit of raw text tables: profiles, placeholders, formats, outliers, categories, duplicates.

Results are one row per finding or per group. Groupings count before they shuffle, so a placeholder
or module that holds a third of all rows reaches the next stage as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import mean_of, rounded
from cohortlens.functions.ordering import ascending, descending
from cohortlens.functions.text import UNSIGNED, matches

#: Raw numbers may be long. Up to this many digits before the point they are exact decimals, and so are their
#: sums; longer ones are read as doubles, and only then is a mean one too.
EXACT_DIGITS = 28
WIDE_DECIMAL, WIDE_INTEGER = "decimal(38,4)", "decimal(38,0)"


def is_long(text: Column) -> Column:
    """Whether a number's text has more digits before the point than are read exactly."""
    return F.length(F.ltrim(F.substring_index(text, ".", 1), F.lit("-0"))) > EXACT_DIGITS


def exact_and_long(text: Column, pattern: str, type: str) -> tuple[Column, Column]:
    """The exact decimal and the double of a number's text; one of them, or for other texts both, is NULL."""
    number = matches(text, pattern)
    return F.when(number & ~is_long(text), text.cast(type)), F.when(number & is_long(text), text.cast("double"))


def profile_of(type: str) -> list[Column]:
    """Minimum, maximum, mean and sample standard deviation of the columns ``value`` and ``long``."""
    scale = int(type.rstrip(")").split(",")[1]) if "," in type else 0
    both = F.coalesce(F.col("value").cast("double"), F.col("long"))
    exact = rounded(mean_of(F.col("value"), scale, EXACT_DIGITS), 1)
    return [
        F.least(F.min("value").cast("double"), F.min("long")).alias("minimum"),
        F.greatest(F.max("value").cast("double"), F.max("long")).alias("maximum"),
        F.when(F.count("long") == 0, exact).otherwise(F.round(F.avg(both), 1)).alias("durchschnitt"),
        F.round(F.stddev_samp(both), 1).alias("streuung"),
    ]


def distinct_profile(df: DataFrame, group: str, entities: Mapping[str, str]) -> DataFrame:
    """Exact number of distinct entities per group, most first. ``entities``: result name → column."""
    names = list(entities)
    return (
        df.groupBy(group)
        .agg(*[F.count_distinct(F.col(column)).alias(name) for name, column in entities.items()])
        .orderBy(*descending(names[0]), *ascending(group))
    )


def group_counts(df: DataFrame, *keys: str, name: str = "anzahl") -> DataFrame:
    """Rows per key combination."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(*ascending(*keys))


def numeric_profile(
    df: DataFrame,
    column: str,
    pattern: str = UNSIGNED,
    group: str | None = None,
    type: str = WIDE_DECIMAL,
) -> DataFrame:
    """Minimum, maximum, mean and sample standard deviation of a text column's numeric values."""
    value, long = exact_and_long(F.col(column), pattern, type)
    values = df.select(*([group] if group else []), value.alias("value"), long.alias("long")).where(
        F.col("value").isNotNull() | F.col("long").isNotNull()
    )
    profile = (values.groupBy(group) if group else values.groupBy()).agg(*profile_of(type))
    return profile.orderBy(*descending("streuung"), *ascending(group)) if group else profile


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "anzahl") -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > 1)


def invalid_format_count(df: DataFrame, column: str, pattern: str = UNSIGNED) -> DataFrame:
    """Number of non-NULL values in another format. NULL does not count."""
    return df.agg(F.count_if(~matches(F.col(column), pattern)).alias("anzahl"))


def missing_by_group(df: DataFrame, column: str, group: str, placeholder: str = "?") -> DataFrame:
    """Rows with the placeholder per group, fewest first; groups without any are left out."""
    return (
        df.where(F.col(column) == placeholder)
        .groupBy(group)
        .agg(F.count("*").alias("anzahl"))
        .orderBy(*ascending("anzahl", group))
    )


def missing_by_type(df: DataFrame, column: str, category: str, pattern: str = UNSIGNED) -> DataFrame:
    """Rows per category whose value is NULL or in another format."""
    value = F.col(column)
    return (
        df.where(value.isNull() | ~matches(value, pattern))
        .groupBy(category)
        .agg(F.count("*").alias("anzahl"))
        .orderBy(*ascending(category))
    )


def placeholder_counts(
    df: DataFrame, column: str, category: str, placeholders: Sequence[str] = ("", "?")
) -> DataFrame:
    """All rows and rows with a placeholder per category; NULL is not a placeholder here."""
    return (
        df.groupBy(category)
        .agg(
            F.count("*").alias("anzahl"),
            F.count_if(F.col(column).isin(*placeholders)).alias("platzhalter"),
        )
        .orderBy(*descending("platzhalter"), *ascending(category))
    )


def number_in(column: str) -> Column:
    """The integer in a text column, NULL for any other format; one that is too long as the least such number."""
    text = F.col(column)
    least_long = F.lit("1" + "0" * EXACT_DIGITS).cast(WIDE_INTEGER)
    return F.when(matches(text, UNSIGNED), F.when(is_long(text), least_long).otherwise(text.cast(WIDE_INTEGER)))


def outlier_count(df: DataFrame, column: str, threshold: int) -> DataFrame:
    """Number of integer values above the threshold."""
    return df.agg(F.count_if(number_in(column) > threshold).alias("anzahl"))


def outlier_buckets(
    df: DataFrame,
    column: str,
    threshold: int,
    buckets: Sequence[tuple[str, int, int]],
    beyond: str,
) -> DataFrame:
    """Integer values above the threshold per bucket, smallest bucket first.

    ``buckets`` lists (label, lowest, highest), both ends included; what fits none is ``beyond``.
    """
    value = F.col("value")
    label = F.lit(beyond)
    for name, lowest, highest in reversed(buckets):
        label = F.when(value.between(lowest, highest), name).otherwise(label)
    return (
        df.select(number_in(column).alias("value"))
        .where(value > threshold)
        .groupBy(label.alias("bereich"))
        .agg(F.count("*").alias("anzahl"), F.min(value).alias("kleinster"))
        .orderBy("kleinster")
        .drop("kleinster")
    )


def numeric_audit(df: DataFrame, column: str, threshold: int, pattern: str = UNSIGNED) -> DataFrame:
    """Rows, wrong formats, profile and outliers of a text column of integers, in one pass.

    The same figures as ``invalid_format_count``, ``numeric_profile`` and ``outlier_count``.
    """
    text = F.col(column)
    value, long = exact_and_long(text, pattern, WIDE_INTEGER)
    valued = df.select(text.alias("text"), value.alias("value"), long.alias("long"))
    return valued.agg(
        F.count("*").alias("zeilen"),
        F.count_if(~matches(F.col("text"), pattern)).alias("ungueltig"),
        *profile_of(WIDE_INTEGER),
        F.count_if(F.coalesce(F.col("value") > threshold, F.col("long") > threshold)).alias("ausreisser"),
    )


def category_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of several text columns, as (column name, value), in one pass."""
    values = [F.struct(F.lit(c).alias("spalte"), F.col(c).alias("wert")) for c in columns]
    return (
        df.select(F.inline(F.array(*values))).distinct().orderBy(*ascending("spalte", "wert"))
    )


def whitespace_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values of several text columns that have leading or trailing spaces, in one pass."""
    return category_domains(df, columns).where(F.col("wert") != F.trim("wert"))


def category_domain(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, NULL last."""
    return df.select(column).distinct().orderBy(*ascending(column))


def whitespace_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with leading or trailing spaces."""
    return df.select(column).where(F.col(column) != F.trim(F.col(column))).distinct()
