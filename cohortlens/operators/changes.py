"""What changed between two tables with the same key: keys added, removed and changed, and which columns.

Only the key and a digest of the row are shuffled. The columns are compared for the keys whose digests
differ, and for no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.integrity import union_all
from cohortlens.session import cut_lineage

ADDED, REMOVED, CHANGED, REPEATED = "hinzugekommen", "entfallen", "geaendert", "schluessel_mehrfach"


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns; NULL differs from every text, also from an empty one."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256))


def same_key(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}")) for key in keys])


def key_states(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every key whose row is not the same on both sides, with its ``state``.

    A key that one side has more than once is ``schluessel_mehrfach``, since its rows cannot be paired.
    """
    digest = row_digest(values).alias("digest")
    sides = old.select(*keys, digest, F.lit(True).alias("is_old")).unionByName(
        new.select(*keys, digest, F.lit(False).alias("is_old"))
    )
    per_key = sides.groupBy(*keys).agg(
        F.count_if("is_old").alias("n_old"),
        F.count_if(~F.col("is_old")).alias("n_new"),
        F.min("digest").alias("least"),
        F.max("digest").alias("greatest"),
    )
    state = (
        F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), REPEATED)
        .when(F.col("n_old") == 0, ADDED)
        .when(F.col("n_new") == 0, REMOVED)
        .when(F.col("least") != F.col("greatest"), CHANGED)
    )
    return per_key.select(*keys, state.alias("state")).where("state IS NOT NULL")


def changed_rows(old: DataFrame, new: DataFrame, states: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per changed key: the names of its changed columns."""
    wanted = states.where(F.col("state") == CHANGED).select(*keys).alias("k")
    before = wanted.join(old.alias("o"), same_key(keys, "k", "o")).select(
        *[F.col(f"k.{key}").alias(key) for key in keys], F.struct(*[F.col(f"o.{v}").alias(v) for v in values]).alias("before")
    )
    after = new.alias("n")
    names = [F.when(~F.col(f"b.before.{v}").eqNullSafe(F.col(f"n.{v}")), F.lit(v)) for v in values]
    return before.alias("b").join(after, same_key(keys, "b", "n")).select(
        *[F.col(f"b.{key}").alias(key) for key in keys], F.array_compact(F.array(*names)).alias("spalten")
    )


def table_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per kind of change, and per changed column: ``art``, ``spalte``, ``anzahl``.

    ``art`` is ``hinzugekommen``, ``entfallen``, ``geaendert`` (keys in both tables with another row) or
    ``schluessel_mehrfach``, each always present and without a ``spalte``; and ``spalte`` with how many
    changed rows have another value in that column, for every column of ``old`` beside the keys. NULL
    equals NULL, in keys too. Columns that only ``new`` has are ignored.
    """
    values = [name for name in old.columns if name not in keys]
    states = cut_lineage(key_states(old, new, keys, values))
    kinds = [ADDED, REMOVED, CHANGED, REPEATED]
    counts = states.agg(*[F.count_if(F.col("state") == kind).alias(kind) for kind in kinds])
    columns = changed_rows(old, new, states, keys, values).agg(
        *[F.count_if(F.array_contains("spalten", v)).alias(f"c{place}") for place, v in enumerate(values)]
    )

    def listed(row: DataFrame, entries: list[tuple[str, str | None, str]]) -> DataFrame:
        made = [
            F.struct(F.lit(art).alias("art"), F.lit(name).cast("string").alias("spalte"), F.col(source).alias("anzahl"))
            for art, name, source in entries
        ]
        return row.select(F.inline(F.array(*made)))

    parts = [listed(counts, [(kind, None, kind) for kind in kinds])]
    if values:
        parts.append(listed(columns, [("spalte", v, f"c{place}") for place, v in enumerate(values)]))
    return union_all(parts)
