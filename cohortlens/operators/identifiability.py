"""Can the coefficients of a design be told apart?

Spark's regression returns coefficients with enormous standard errors for a singular design instead
of failing, so a design is examined before it is fitted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SingularDesign(ValueError):
    """Some term is constant or a combination of other terms."""


def type_correlation(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Pearson correlation of every pair of columns, from one pass; one row per pair."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(
            F.lit(a).alias("merkmal_a"),
            F.lit(b).alias("merkmal_b"),
            F.round(F.col(f"r{i}"), digits).alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*entries)))


def constant_within_group(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Per group and column, whether the column has no spread there."""
    spread = df.groupBy(group).agg(
        *[F.coalesce(F.max(c) == F.min(c), F.lit(True)).alias(c) for c in columns]
    )
    entries = [
        F.struct(F.lit(c).alias("merkmal"), F.col(c).cast("int").alias("konstant")) for c in columns
    ]
    return spread.select(group, F.inline(F.array(*entries)))


def identifiability_report(
    df: DataFrame, columns: Sequence[str], group: str, high: float = 0.8
) -> DataFrame:
    """Pairs of columns with their correlation, columns without spread in a group, and the rank of the design.

    ``auffaellig`` is 1 for a correlation of at least ``high`` in absolute value, for a constant, and for
    a design of intercept and columns whose rank (``wert``) is below its number of terms; then
    ``merkmal_a`` names the dependent terms and ``merkmal_b_oder_gruppe`` what they depend on.
    """
    pairs = type_correlation(df, columns).select(
        F.lit("korrelation").alias("pruefung"),
        "merkmal_a",
        F.col("merkmal_b").alias("merkmal_b_oder_gruppe"),
        F.col("r").alias("wert"),
        F.when(F.abs("r") >= high, 1).otherwise(0).alias("auffaellig"),
    )
    constants = constant_within_group(df, columns, group).select(
        F.lit("konstant").alias("pruefung"),
        F.col("merkmal").alias("merkmal_a"),
        F.col(group).alias("merkmal_b_oder_gruppe"),
        F.lit(None).cast("double").alias("wert"),
        F.col("konstant").alias("auffaellig"),
    )
    found = rank_of(df, columns)
    supports = [term for term in found.independent if any(term in alias for alias in found.aliases.values())]
    rank = df.sparkSession.createDataFrame(
        [("rang", ", ".join(found.aliases), ", ".join(supports), float(found.rank), int(bool(found.aliases)))],
        pairs.schema,
    )
    return pairs.unionByName(constants).unionByName(rank)


INTERCEPT = "(Konstante)"


@dataclass(frozen=True)
class Rank:
    """The independent terms of a design in their order, and each other term as a combination of them."""

    independent: tuple[str, ...]
    aliases: dict[str, dict[str, float]]

    @property
    def rank(self) -> int:
        return len(self.independent)


def design_rank(gram: np.ndarray, terms: Sequence[str], tolerance: float = 1e-9, digits: int = 6) -> Rank:
    """Rank and aliases of a design from its cross products.

    A Cholesky factorisation with limited pivoting: terms are taken in their order, and one that leaves
    less than ``tolerance`` of its square sum beside the terms before it is moved to the end. So of a
    dependent set the last term is the one reported, as a combination of earlier ones; coefficients that
    are 0 to ``digits`` places are left out. A term that is always zero depends on nothing.
    """
    scale = np.sqrt(np.diag(gram))
    safe = np.where(scale > 0, scale, 1.0)
    unit = gram / np.outer(safe, safe)
    chosen: list[int] = []
    rows: list[np.ndarray] = []  # of the factor: one per chosen term
    dependent: list[int] = []
    rest = unit.copy()
    for k in range(len(terms)):
        if scale[k] == 0 or rest[k, k] <= tolerance:
            dependent.append(k)
            continue
        row = rest[k] / np.sqrt(rest[k, k])
        rest = rest - np.outer(row, row)
        chosen.append(k)
        rows.append(row)
    factor = np.array(rows).reshape(len(chosen), len(terms))
    aliases = {}
    for k in dependent:
        weights = np.linalg.solve(factor[:, chosen], factor[:, k]) if chosen else np.array([])
        weights = weights * safe[k] / safe[chosen] if scale[k] > 0 else np.zeros(len(chosen))
        aliases[terms[k]] = {terms[c]: float(round(w, digits)) for c, w in zip(chosen, weights) if round(w, digits)}
    return Rank(tuple(terms[c] for c in chosen), aliases)


def rank_of(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> Rank:
    """The rank of the design of an intercept and ``columns``, from one pass over ``df``.

    Rows with a NULL among the columns are left out, as a fit would. Only the cross products, a matrix of
    terms by terms, reach the driver.
    """
    weighted = df.select(*columns).dropna().withColumn("_rows", F.lit(1.0))
    gram = gram_matrix(weighted, columns, "_rows")
    return design_rank(gram, [INTERCEPT, *columns], tolerance)


def rank_report(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per term of the design whether it is independent; of a dependent term a row per term it depends on.

    ``abhaengig_von`` and ``koeffizient`` are NULL for an independent term and for one that is always zero;
    ``rang`` and ``terme`` repeat the design's rank and number of terms.
    """
    found = rank_of(df, columns, tolerance)
    terms = [INTERCEPT, *columns]
    rows = [
        (term, int(term in found.independent), other, weight, found.rank, len(terms))
        for term in terms
        for other, weight in found.aliases.get(term, {}).items() or [(None, None)]
    ]
    schema = "term string, unabhaengig int, abhaengig_von string, koeffizient double, rang int, terme int"
    return df.sparkSession.createDataFrame(rows, schema)


def gram_matrix(rows: DataFrame, columns: Sequence[str], weight: str) -> np.ndarray:
    """Weighted cross products of all columns and a leading 1, summed by Spark into one row."""
    factors = ["1D", *[term_name(c) for c in columns]]
    size = len(factors)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [f"sum({factors[i]} * {factors[j]} * {term_name(weight)}) AS g{i}_{j}" for i, j in cells]
    row = rows.selectExpr(*sums).first()
    gram = np.zeros((size, size))
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    return gram


def term_name(term: str) -> str:
    """A column name that may contain any character."""
    return f"`{term}`"


def require_identifiable(gram: np.ndarray, terms: Sequence[str], tolerance: float = 1e-10) -> None:
    """Raise ``SingularDesign`` unless intercept and terms are linearly independent."""
    scale = np.sqrt(np.diag(gram))
    if not (scale > 0).all():
        empty = [term for term, s in zip(["(rows)", *terms], scale) if s == 0]
        raise SingularDesign(f"always zero: {', '.join(empty)}")
    smallest = np.linalg.eigvalsh(gram / np.outer(scale, scale))[0]
    if smallest < tolerance:
        raise SingularDesign(
            f"terms are not linearly independent: {', '.join(terms)} "
            f"(smallest eigenvalue {smallest:.1e})"
        )
