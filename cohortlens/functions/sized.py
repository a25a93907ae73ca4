"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def small_side(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` ready to broadcast if it has at most ``max_rows`` rows, otherwise ``df`` unchanged.

    Meant for one row per group next to detail rows: a shuffle by group would put every detail row
    of a large group into one task. Reads at most ``max_rows + 1`` rows; with more groups than that
    Spark joins the two sides as it sees fit.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


#: A factor's levels become terms, and the driver holds a square matrix of terms: 1,000 of them take 8 MB.
MAX_LEVELS = 1_000


class TooManyLevels(ValueError):
    """A column has more values than a model factor can have levels."""


def distinct_values(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list:
    """The sorted distinct non-NULL values of a category column; more than ``max_levels`` are refused.

    Meant for the levels of a model factor. At most ``max_levels + 1`` values reach the driver. Pass the
    levels instead of reading them if they are known.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise TooManyLevels(f"{column} has more than {max_levels} values")
    return sorted(row[0] for row in rows)
