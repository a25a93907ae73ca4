"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities: of lexicon words (by weight, by count, by different ones), of
lexicon words close to an address in the second person, of capitals, of punctuation, of obfuscated words,
and of lexicon words that only show once the obfuscation is undone.

Nothing but texts and labels goes in. The lexicon is learned: whole words and beginnings of words that
significantly more toxic than clean labelled documents contain. The labelled documents are split by the
CRC-32 of their id: remainder 0 of 5 is held out from everything, 4 calibrates, the others teach the
lexicon and the trees. At most ``max_labelled`` labelled documents are used (those with the smallest hash
of their id); every document is scored, in the map stage and whole, by Spark's own models.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortlens.llm.common import TwoGenerations, text_or_empty
from cohortlens.session import cut_lineage

FOLDS, HELD_OUT, CALIBRATES = 5, 0, 4

#: The bound on labelled documents for the fit, and on the learned lexicon.
MAX_LABELLED, MAX_LEXICON = 20_000, 400
#: An entry needs this many toxic documents and this log-likelihood ratio (one degree of freedom, about p = 3e-4).
LEAST_DOCUMENTS, LEAST_RATIO = 3, 13.0
PREFIXES = (4, 5, 6, 7)
TREES, DEPTH, STEP = 15, 3, 0.3

#: Address in the second person, in the languages of the texts.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tus os".split()
)
NEAR = 5
#: What digits and signs inside a word stand for.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"})

EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
MIXED = re.compile(r"[^\W\d_][\d@$!+*._\-]+[^\W\d_]")
RUN = re.compile(r"([^\W\d_])\1\1")
NOT_LETTER = re.compile(r"[\W\d_]+")

FEATURES = (
    "weight_per_word", "hits_per_word", "hits", "different_hits", "strongest_hit", "hits_near_second_person",
    "second_person_per_word", "capital_words", "capitals", "exclamations", "punctuation", "obfuscated", "hidden_hits", "letter_runs",
)


def entries_of(word: str) -> list[str]:
    """What a lexicon may hold of a lower-cased word: the word itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def weight_of(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(entry, 0.0) for entry in entries_of(word)), default=0.0) if word else 0.0


class Marks:
    """What each token contributes, by small codes; code 0 is a plain word. Held per worker and lexicon."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.codes = {(0.0, 0.0, False, False, False, False): 0}
        self.rows = np.zeros((1, 6))
        self.code_of = TwoGenerations(self.code)

    def code(self, token: str) -> int:
        core = EDGES.sub("", token)
        lower = core.lower()
        weight = weight_of(lower, self.lexicon)
        mixed = bool(MIXED.search(token))
        run = bool(RUN.search(core))
        hidden = 0.0
        if not weight and (mixed or run or len(core) < len(token)):
            plain = token.lower().translate(PLAIN)
            tries = {NOT_LETTER.sub("", plain), NOT_LETTER.sub("", token.lower())}
            tries |= {re.sub(r"(.)\1+", r"\1", t) for t in tries}
            hidden = max((weight_of(t, self.lexicon) for t in tries if t != lower), default=0.0)
        mark = (weight, hidden, lower in SECOND_PERSON, len(core) > 1 and core.isupper(), mixed, run)
        if mark not in self.codes:
            self.codes[mark] = len(self.codes)
            self.rows = np.vstack([self.rows, np.array(mark, float)])
        return self.codes[mark]

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        codes = np.fromiter(map(self.code_of.__getitem__, tokens), np.int64, n)
        marked = np.flatnonzero(codes)
        weight, hidden, second, capital, mixed, run = self.rows[codes[marked]].T
        hits = marked[weight > 0]
        people = marked[second > 0]
        near = 0
        if len(hits) and len(people):
            after = np.searchsorted(people, hits - NEAR)
            near = int((people[np.minimum(after, len(people) - 1)] <= hits + NEAR)[after < len(people)].sum())
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        upper = np.count_nonzero((raw >= 65) & (raw <= 90))
        lower = np.count_nonzero((raw >= 97) & (raw <= 122))
        signs = np.count_nonzero((raw > 32) & (raw < 127)) - upper - lower - np.count_nonzero((raw >= 48) & (raw <= 57))
        shouts = np.count_nonzero((raw == 33) | (raw == 63))
        return [
            weight.sum() / n,
            len(hits) / n,
            float(np.log1p(len(hits))),
            float(np.log1p(len({tokens[k].lower() for k in hits}))),
            float(weight.max(initial=0.0)),
            near / max(1, len(hits)),
            len(people) / n,
            capital.sum() / n,
            upper / max(1, upper + lower),
            shouts / n,
            signs / len(raw),
            mixed.sum() / n,
            hidden.sum() / n,
            run.sum() / n,
        ]


#: Marks of this worker process, by lexicon; tasks that come later find the cache warm.
HELD: dict[tuple, Marks] = {}


def held_marks(key: tuple) -> Marks:
    """Not inside the UDF: that would bring a copy of ``HELD`` along."""
    if key not in HELD:
        HELD.clear()
        HELD[key] = Marks(dict(key))
    return HELD[key]


def features_of(lexicon: dict[str, float], texts: Column) -> Column:
    key = tuple(sorted(lexicon.items()))

    @F.pandas_udf(ArrayType(DoubleType()))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = held_marks(key)
        for batch in batches:
            yield pd.Series([marks.features(text) for text in batch], dtype="object")

    return array_to_vector(measured(texts))


def fold(column: str = "doc_id") -> Column:
    """The remainder by which documents are split; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, fold, text, toxic`` of labelled documents that are not held out, a row per id; stored.

    Several labels of a document: toxic if one says so. Several texts of an id: the greatest. Only the
    ids and labels of the sample are broadcast, at most ``max_labelled`` rows.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    return cut_lineage(
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(cut_lineage(chosen)), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("doc_id", fold().alias("fold"), "text", "toxic")
    )


def learned_lexicon(taught: DataFrame) -> dict[str, float]:
    """Entries that significantly more toxic than clean documents of ``taught`` contain, with their log odds."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    starts = F.transform(
        F.filter("words", lambda w: w != ""),
        lambda w: F.concat(
            F.array(w),
            *(
                F.when(F.length(w) >= n, F.array(F.concat(F.substring(w, 1, n), F.lit("*")))).otherwise(F.array())
                for n in PREFIXES
            ),
        ),
    )
    sizes = taught.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, n = sizes["bad"] or 0, sizes["n"]
    good = n - bad
    if not bad or not good:
        return {}
    counts = (
        taught.select(words.alias("words"), "toxic")
        .select(F.explode(F.array_distinct(F.flatten(starts))).alias("entry"), "toxic")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("a"), F.count("*").alias("m"))
        .where(F.col("a") >= LEAST_DOCUMENTS)
    )

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, m = F.col("a"), F.col("m")
    ratio = 2 * (
        part(a, m * bad / n)
        + part(m - a, m * good / n)
        + part(bad - a, (n - m) * bad / n)
        + part(good - (m - a), (n - m) * good / n)
    )
    odds = F.log((a + 0.5) / (bad + 1.0)) - F.log((m - a + 0.5) / (good + 1.0))
    best = (
        counts.select("entry", ratio.alias("ratio"), odds.alias("odds"))
        .where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 0))
        .orderBy(F.desc("ratio"), "entry")
        .limit(MAX_LEXICON)
    )
    return {row["entry"]: round(row["odds"], 6) for row in best.collect()}


@dataclass
class Toxicity:
    """A fitted model; without both labels in the training rows it only knows their ``rate``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float

    def raw(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (without columns named ``features`` or ``raw``) with the trees' probability as ``raw``."""
        measured = docs.withColumn("features", features_of(self.lexicon, text_or_empty()))
        scored = self.trees.transform(measured)
        return scored.select(*(F.col(f"`{name}`") for name in docs.columns), vector_to_array("probability")[1].alias("raw"))

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id`` and ``score`` (0 to 1) of every row of ``docs``; a NULL text is an empty one."""
        slim = docs.select("doc_id", "text")
        if self.trees is None:
            return slim.select("doc_id", F.lit(self.rate).alias("score"))
        raw = self.raw(slim)
        if self.calibration is None:
            return raw.select("doc_id", F.col("raw").alias("score"))
        done = self.calibration.transform(raw)
        return done.select("doc_id", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Toxicity:
    """A model from the labelled documents that are not held out.

    Labels or ids that are NULL count for nothing. Without a toxic and a clean document among the rows
    that teach there are no trees, without calibrating rows of both kinds no calibration.
    """
    known = labelled(docs, labels, max_labelled)
    taught, calibrating = known.where(F.col("fold") != CALIBRATES), known.where(F.col("fold") == CALIBRATES)
    counted = known.groupBy((F.col("fold") == CALIBRATES).alias("late"), "toxic").agg(F.count("*").alias("n"))
    kinds = {(row["late"], row["toxic"]): row["n"] for row in counted.collect()}
    total = sum(kinds.values())
    rate = sum(n for (_, toxic), n in kinds.items() if toxic) / total if total else 0.0
    if not (kinds.get((False, 1)) and kinds.get((False, 0))):
        return Toxicity({}, None, None, rate)
    lexicon = learned_lexicon(taught)
    label = F.col("toxic").cast("double").alias("label")
    rows = cut_lineage(taught.select(features_of(lexicon, F.col("text")).alias("features"), label))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(rows)
    model = Toxicity(lexicon, trees, None, rate)
    if kinds.get((True, 1)) and kinds.get((True, 0)):
        seen = model.raw(calibrating.select("doc_id", "text", label))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated")
        model.calibration = calibration.fit(cut_lineage(seen.select("raw", "label")))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted`` (1 from a score of 0.5 on).

    NULL and empty texts are scored like any other. A NULL id counts as an empty text in the split, so it
    is held out. Repeated rows get the same score. Without usable labels every score is the rate of toxic
    training documents, 0 without any. Other columns are ignored. An empty table gives an empty table.
    """
    scores = fit_toxicity(docs, labels, max_labelled).score(docs)
    return scores.select(
        "doc_id",
        (fold() == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
