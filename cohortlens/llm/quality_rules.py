"""Quality rules whose cutoffs come with a guarantee on wrongly rejected good documents.

Base rules are fixed. Beside them each rule compares a share of the text with a cutoff, and the cutoff
of each stratum is chosen on a labelled holdout: the good documents that pass the base rules. For a
cutoff, the hypothesis "it rejects more than ``risk`` of the good documents" is tested with the exact
binomial distribution. The cutoffs of a rule are tested from the most lenient to the strictest and
testing stops at the first that is not proven (a fixed sequence needs no correction); the level is
divided by the number of rules times the number of strata (Bonferroni). So with probability
``1 - level``, in every stratum at once, all rules together reject at most ``risk`` of the good
documents. A stratum with too few labels proves nothing, and there only the base rules hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortlens.functions.sized import small_side
from cohortlens.llm.common import kept_for, packed, text_or_empty
from cohortlens.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Shares in thousandths and the cutoffs tried, from lenient to strict. A text at or above it is rejected.
CUTOFFS = (800, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 15, 10)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more."""
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(word, len(known)) for word in words], np.int64)
    if len(known) == len(words):
        return 0
    pairs = codes[:-1] * len(known) + codes[1:]
    if len(known) >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + codes[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    first = np.flatnonzero(times[place] > 1)
    inside = np.zeros(len(codes), bool)
    for offset in range(3):
        inside[first + offset] = True
    return int(inside.sum())


def text_features(text: str) -> tuple[int, ...]:
    """The values of ``FEATURES`` for a whole text."""
    words = text.encode().split()
    lines = text.split("\n")
    with_word = [line for line in lines if line.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(with_word) - len(set(with_word)),
        repeated_words(words),
        len(with_word),
    )


@F.pandas_udf(StructType([StructField(name, LongType()) for name in FEATURES]))
def features_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    kept_for("quality_rules")
    for texts in batches:
        yield pd.DataFrame([text_features(text) for text in texts], columns=FEATURES, dtype="int64")


#: Declared non-deterministic, which it is not: else Spark runs it once more, in a second worker process of each
#: task, for the conditions that it moves below the join with the cutoffs.
features_once = features_of.asNondeterministic()


def base_failed(features: str = "features") -> Column:
    n, repeats = F.col(f"{features}.n_words"), F.col(f"{features}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def shares(features: str = "features") -> dict[str, Column]:
    """Each rule's share in thousandths; 0 where there is nothing to divide by."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("long")

    value = {name: F.col(f"{features}.{name}") for name in FEATURES}
    return {
        "symbols": share(value["n_symbols"], value["word_chars"]),
        "dup_lines": share(value["n_dup_lines"], value["n_lines"]),
        "repeats": share(value["n_repeat_words"], value["n_words"]),
    }


def beta_part(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_part(1.0 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * total


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of at most ``k`` among ``n`` at rate ``p``."""
    return 1.0 if k >= n else beta_part(1.0 - p, n - k, k + 1)


def strictest_proven(rejected: list[int], n: int, risk: float, level: float) -> int | None:
    """The last of the cutoffs, tested in order, whose rate of rejection is proven to be below ``risk``."""
    proven = None
    for cutoff, k in zip(CUTOFFS, rejected):
        if n == 0 or binomial_tail(k, n, risk) > level:
            break
        proven = cutoff
    return proven


def stratum_of(column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def with_features(docs: DataFrame, text_column: str = "text", stratum_column: str | None = "lang") -> DataFrame:
    """``docs`` with the struct ``features`` and ``stratum``, computed in the map stage."""
    return docs.withColumns(
        {"features": features_once(text_or_empty(text_column)), "stratum": stratum_of(stratum_column)}
    )


def thresholds(
    measured: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, id_column: str = "doc_id"
) -> DataFrame:
    """Per stratum: ``stratum``, ``n_good`` and a cutoff per rule (NULL where none is proven).

    ``measured`` has the id, ``stratum`` and ``features``. All labelled rows count. A document with
    several labels is good only if all of them say so; labels or ids that are NULL count for nothing.
    Only counts per stratum and cutoff leave the map stage.
    """
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias(id_column))
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select(id_column)
    )
    rules = shares()
    rejected = {name: F.array(*(F.sum((share >= c).cast("long")) for c in CUTOFFS)) for name, share in rules.items()}
    counted = cut_lineage(
        measured.where(~base_failed())
        .join(good, id_column)
        .groupBy("stratum")
        .agg(F.count("*").alias("n_good"), *(column.alias(name) for name, column in rejected.items()))
    )
    per_rule, per_test = risk / len(rules), level / (max(1, counted.count()) * len(rules))

    @F.pandas_udf("long")
    def cutoff(n: pd.Series, k: pd.Series) -> pd.Series:
        found = [strictest_proven(list(ks), int(ns), per_rule, per_test) for ns, ks in zip(n, k)]
        return pd.Series(found, dtype="Int64")

    return counted.select("stratum", "n_good", *(cutoff("n_good", name).alias(name) for name in rules))


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; a rule without a proven cutoff rejects nothing."""
    limits = cutoffs.select("stratum", F.struct(*shares()).alias("limits"))
    over = F.lit(False)
    for name, share in shares().items():
        over = over | F.coalesce(share >= F.col(f"limits.{name}"), F.lit(False))
    failed = base_failed()
    return (
        measured.join(small_side(cut_lineage(limits)), "stratum", "left")
        .withColumns({"base_failed": failed, "kept": ~failed & ~over})
        .drop("limits")
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, stratum_column: str | None = "lang"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the features, ``base_failed`` and ``kept``.

    A NULL or empty text has no words and fails the base rules. A NULL language is a stratum of its
    own, together with the empty one. Repeated rows are judged alike. Without labels only the base
    rules hold. Other columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    chosen = docs.select("doc_id", *([stratum_column] if stratum_column else []), "text")
    measured = cut_lineage(with_features(chosen, stratum_column=stratum_column).select("doc_id", "stratum", "features"))
    return judged(measured, thresholds(measured, labels, risk, level)).select(
        "doc_id", "features.*", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the columns of ``docs``.

    The texts are not shuffled: the verdict is worked out anew beside each text. NULLs, repeated rows
    and empty tables are treated as there.
    """
    small = docs.select("doc_id", "lang", "text")
    measured = cut_lineage(with_features(small).select("doc_id", "stratum", "features"))
    cutoffs = thresholds(measured, labels, risk, level)
    # Each text stands in a row once, so that no second copy waits beside it for its features.
    beside = with_features(docs.select(packed(docs).alias("row")), "row.text", "row.lang")
    return judged(beside, cutoffs).where("kept").select("row.*")
