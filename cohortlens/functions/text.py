"""Accepted formats of text columns, and guarded casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in the raw tables. Java's `$` also matches before a final
# newline, hence `\z`.
UNSIGNED = r"^[0-9]+\z"
SIGNED = r"^-?[0-9]+\z"
DECIMAL = r"^[0-9]+\.?[0-9]*\z"


def matches(column: Column, pattern: str) -> Column:
    """TRUE / FALSE, NULL for NULL."""
    return column.rlike(pattern)


def cast_if(column: Column, pattern: str, to: str) -> Column:
    """``column`` cast to ``to`` where it has the format, else NULL.

    The format decides, then a hard cast follows: a value that looks right but does not fit the
    type fails the job instead of turning into NULL.
    """
    return F.when(matches(column, pattern), column.cast(to))


def bounded_text(column: Column, name: str, length: int) -> Column:
    """``column`` unchanged, failing the job on a value longer than ``length``."""
    too_long = F.raise_error(F.concat(F.lit(f"{name}: longer than {length}: "), column)).cast("string")
    return F.when(F.char_length(column) > length, too_long).otherwise(column)


def recoded(column: Column, mapping: dict[str, str | None]) -> Column:
    """``column`` with the listed values replaced, all others kept."""
    result = column
    for old, new in mapping.items():
        result = F.when(column == old, F.lit(new).cast("string")).otherwise(result)
    return result
