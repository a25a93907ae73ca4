"""All references between tables checked in one pass.

Every table is read once. A row gives one entry for each set of key columns ("shape") in which its table
is a child or a parent, and the entries of all tables are counted per key and table in one grouping, in
the map stage first: a table of events sends a row per key and task, and a single key with very many
events is one row of that. A child's rows are orphans where the parent's count for the same key is 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.integrity import union_all
from cohortlens.sources.schemas import Reference


def key_counts(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """Per key shape and key: how many rows of each table have it, as columns ``n_<table>``.

    Columns of keys outside a row's shape are NULL. A key with a NULL in it is left out: as a child it
    refers to nothing, as a parent nothing can refer to it.
    """
    shapes = list(dict.fromkeys(ref.keys for ref in references))
    columns = list(dict.fromkeys(key for shape in shapes for key in shape))
    names = list(dict.fromkeys(name for ref in references for name in (ref.child, ref.parent)))

    def typed_null(key: str):
        holder = next(ref.child for ref in references if key in ref.keys)
        return F.lit(None).cast(tables[holder].schema[key].dataType)

    def entries(name: str) -> DataFrame:
        used = [shape for shape in shapes if any(r.keys == shape and name in (r.child, r.parent) for r in references)]
        entry = [
            F.when(
                reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in shape]),
                F.struct(
                    F.lit(shapes.index(shape)).alias("shape"),
                    *[(F.col(key) if key in shape else typed_null(key)).alias(key) for key in columns],
                ),
            )
            for shape in used
        ]
        needed = list(dict.fromkeys(key for shape in used for key in shape))
        exploded = tables[name].select(*needed).select(F.explode(F.array_compact(F.array(*entry))).alias("entry"))
        return exploded.select("entry.*", F.lit(name).alias("table"))

    return (
        union_all([entries(name) for name in names])
        .groupBy("shape", *columns)
        .agg(*[F.count_if(F.col("table") == name).alias(f"n_{name}") for name in names])
    )


def reference_violations(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """One row per reference: orphaned child rows, and the different keys they have.

    Empty tables and references without orphans give 0. Columns beside the keys are not read.
    """
    shapes = list(dict.fromkeys(ref.keys for ref in references))
    found = []
    for place, ref in enumerate(references):
        alone = (F.col("shape") == shapes.index(ref.keys)) & (F.col(f"n_{ref.parent}") == 0)
        children = F.col(f"n_{ref.child}")
        found += [
            F.coalesce(F.sum(F.when(alone, children)), F.lit(0)).alias(f"rows_{place}"),
            F.count_if(alone & (children > 0)).alias(f"keys_{place}"),
        ]
    row = key_counts(tables, references).agg(*found)
    entries = [
        F.struct(
            F.lit(ref.name).alias("beziehung"),
            F.lit(ref.child).alias("kind"),
            F.lit(ref.parent).alias("eltern"),
            F.col(f"rows_{place}").alias("waisen"),
            F.col(f"keys_{place}").alias("schluessel"),
        )
        for place, ref in enumerate(references)
    ]
    return row.select(F.inline(F.array(*entries)))
