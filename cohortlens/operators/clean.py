"""From raw text to typed columns.

A value in a wrong format turns into NULL; no row is dropped and no outlier removed. The work is one
projection per table, so the click table is cleaned in a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import bounded_text, cast_if, recoded
from cohortlens.sources.schemas import ColumnSpec, TableSpec

VARCHAR = re.compile(r"varchar\((\d+)\)")


def typed_column(spec: ColumnSpec) -> Column:
    column = recoded(F.col(spec.name), spec.recode)
    varchar = VARCHAR.fullmatch(spec.type)
    if varchar:
        column = bounded_text(column, spec.name, int(varchar.group(1)))
    elif spec.pattern:
        column = cast_if(column, spec.pattern, spec.type)
    else:
        column = column.cast(spec.type)
    return column.alias(spec.name)


def clean(raw: DataFrame, spec: TableSpec, keep: Column | None = None) -> DataFrame:
    """``raw`` with the types of ``spec``, restricted to the rows where ``keep`` holds."""
    kept = raw if keep is None else raw.where(keep)
    return kept.select(*[typed_column(column) for column in spec.columns])


def rows_of(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key occurs in ``selection``.

    For a table without the filter column, such as submissions, which borrow the module from their
    assessment.
    """
    return df.join(selection.select(key), key, "left_semi")


def in_modules(
    raw: Mapping[str, Callable[[], DataFrame]], name: str, modules: Sequence[str]
) -> DataFrame:
    """The rows of one raw table that belong to the modules."""
    keep = F.col("code_module").isin(*modules)
    df = raw[name]()
    if "code_module" in df.columns:
        return df.where(keep)
    return rows_of(df, raw["assessments"]().where(keep), "id_assessment")


def clean_tables(
    raw: Mapping[str, Callable[[], DataFrame]],
    specs: Mapping[str, TableSpec],
    modules: Sequence[str],
    names: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The tables (all, or the named ones) restricted to ``modules`` and typed.

    ``raw`` gives a function per table, called only for the tables that are needed.
    """
    return {
        name: clean(in_modules(raw, name, modules), specs[name])
        for name in (names or list(specs))
    }


def with_columns(spec: TableSpec, recode: dict[str, dict] | None = None, **types: str) -> TableSpec:
    """``spec`` with other types or recodings for some columns, e.g. ``id_student="bigint"``."""
    recode = recode or {}
    return replace(
        spec,
        columns=tuple(
            replace(c, type=types.get(c.name, c.type), recode=recode.get(c.name, c.recode))
            for c in spec.columns
        ),
    )
