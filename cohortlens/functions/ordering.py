"""Sort orders: NULL last when ascending and first when descending, and ranks of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascending(*names: str) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def descending(*names: str) -> list[Column]:
    return [F.col(name).desc_nulls_first() for name in names]


def rank_of(column: Column, order: Sequence[str]) -> Column:
    """Position of a category in ``order`` from 1, NULL for an unlisted one."""
    return mapped(column, {value: rank for rank, value in enumerate(order, 1)})


def mapped(column: Column, mapping: dict) -> Column:
    """The mapped value, NULL for an unlisted one or NULL."""
    if not mapping:
        return F.lit(None)
    result = None
    for key, value in mapping.items():
        hit = column == key
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result
