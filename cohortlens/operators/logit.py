"""Logistic regression with odds ratios.

Spark's generalised linear regression fits by maximum likelihood: each iteration is one distributed
pass that sums the weighted cross products, and only that small matrix reaches the driver. Designs
of a few discrete terms are first counted per distinct row, which leaves the likelihood as it is and
turns each pass over all enrolments into one over a few hundred weighted rows.

Several models of the same rows are fitted together: their terms are stored once, and each pass over the
stored design sums the cross products of every model that has not settled yet. So the number of passes is
that of the slowest model, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.features import Categorical, design_columns, design_matrix
from cohortlens.operators.identifiability import SingularDesign, gram_matrix, require_identifiable, term_name
from cohortlens.operators.integrity import union_all
from cohortlens.session import cut_lineage

INTERCEPT = "Intercept"
MAX_ITERATIONS = 50
#: Standard errors per standard deviation of the term, and shares of the null deviance, of separated data.
LARGEST_ERROR, PERFECT_FIT = 100.0, 1e-6


class SeparatedData(ValueError):
    """The outcomes are separated by the terms: the likelihood has no maximum."""


class NotConverged(ValueError):
    """The iterations ran out before the fit settled."""


Z_95 = 1.959963984540054

# Odds ratio bands and significance levels, and the labels of the terms.
EFFECT_BANDS = ((1.68, "sehr klein"), (3.47, "klein"), (6.71, "mittel"))
LARGEST_EFFECT = "groß"
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
NOT_SIGNIFICANT = "n.s."
LABELS = {
    "imd": "IMD (1=arm .. 10=reich)",
    "bildung=A_Level": "Bildung: A-Level (Ref: unter A-Level)",
    "bildung=Studium": "Bildung: Studium (Ref: unter A-Level)",
    "code_module=DDD": "Modul: DDD (Ref: BBB)",
    "code_module=FFF": "Modul: FFF (Ref: BBB)",
    "alter_35plus": "Alter 35+ (Ref: unter 35)",
    "disability_ja": "Disability: ja",
    "weiblich": "Geschlecht: weiblich",
    "klicks_z": "Klicks gesamtes Semester (z)",
    "frueh_z": "Klicks erste 4 Wochen (z)",
    "oucontent_z": "Klicks oucontent (z)",
    "forumng_z": "Klicks forumng (z)",
}
DEMOGRAPHY = ("imd", "alter_35plus", "disability_ja", "weiblich")


@dataclass(frozen=True)
class ModelSpec:
    """A model: its title and the activity terms added to the demographic ones."""

    name: str
    title: str
    activity: tuple[str, ...] = ()


def model_specs(types: Sequence[str] = ("oucontent", "forumng")) -> tuple[ModelSpec, ...]:
    """The four models; ``types`` are the two activity types of the last one."""
    return (
        ModelSpec("m1", "Modell 1: nur Demografie"),
        ModelSpec("m2", "Modell 2: + Klicks gesamtes Semester", ("klicks_z",)),
        ModelSpec("m3", "Modell 3: + Klicks erste 4 Wochen", ("frueh_z",)),
        ModelSpec("m4b", f"Modell 4b: + {' & '.join(types)}", tuple(f"{t}_z" for t in types)),
    )


@dataclass(frozen=True)
class LogitFit:
    """Coefficients by term, the intercept first, with standard errors and deviances."""

    terms: tuple[str, ...]
    coefficients: tuple[float, ...]
    standard_errors: tuple[float, ...]
    deviance: float
    null_deviance: float

    @property
    def p_values(self) -> tuple[float, ...]:
        """Two-sided p-values of the z statistics."""
        z = [abs(b / se) for b, se in zip(self.coefficients, self.standard_errors)]
        return tuple(math.erfc(value / math.sqrt(2)) for value in z)

    def score(self) -> Column:
        """The linear predictor of a row of the design matrix."""
        parts = [f"{b!r}D * {term_name(t)}" for t, b in zip(self.terms[1:], self.coefficients[1:])]
        return F.expr(" + ".join([f"{self.coefficients[0]!r}D", *parts]))

    def probability(self) -> Column:
        """The fitted probability of a row of the design matrix."""
        return 1 / (1 + F.exp(-self.score()))


def logit_fit(design: DataFrame, label: str, discrete: bool = False) -> LogitFit:
    """Unregularised logit of ``label`` on all other columns of ``design``.

    ``discrete`` counts equal rows first; use it where the terms take few values. Raises
    ``SingularDesign`` where the coefficients are not determined, ``SeparatedData`` where a term
    separates the outcomes and so has no finite coefficient, ``NotConverged`` where the iterations ran out.
    """
    terms = [name for name in design.columns if name != label]
    quoted = [term_name(name) for name in design.columns]
    if discrete:
        rows = design.groupBy(*quoted).agg(F.count("*").cast("double").alias("_weight"))
    else:
        rows = design.withColumn("_weight", F.lit(1.0))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        gram = gram_matrix(rows, [label, *terms], "_weight")
        require_identifiable(np.delete(np.delete(gram, 1, 0), 1, 1), terms)
        plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        column = dict(zip(rows.columns, plain.columns))
        assembler = VectorAssembler(inputCols=[column[t] for t in terms], outputCol="features")
        regression = GeneralizedLinearRegression(
            family="binomial",
            link="logit",
            labelCol=column[label],
            weightCol=column["_weight"],
            solver="irls",
            regParam=0.0,
            tol=1e-8,
            maxIter=MAX_ITERATIONS,
        )
        model = regression.fit(assembler.transform(plain))
        errors = model.summary.coefficientStandardErrors
        require_convergence(model.summary.numIterations, errors, gram)
        # Spark puts the intercept last.
        fit = LogitFit(
            terms=(INTERCEPT, *terms),
            coefficients=(model.intercept, *model.coefficients.tolist()),
            standard_errors=(errors[-1], *errors[:-1]),
            deviance=0.0,
            null_deviance=null_deviance(float(gram[0, 0]), float(gram[0, 1])),
        )
        fit = replace(fit, deviance=deviance(rows, label, fit))
        if fit.deviance < PERFECT_FIT * fit.null_deviance:
            raise SeparatedData("the terms tell the outcomes apart without error")
        return fit
    finally:
        rows.unpersist()


def require_convergence(iterations: int, errors: Sequence[float], gram: np.ndarray) -> None:
    """Refuse a fit that is none. ``gram`` holds the sums over (1, label, terms)."""
    spread = np.sqrt(np.maximum(np.diag(gram) / gram[0, 0] - (gram[0] / gram[0, 0]) ** 2, 0.0))[2:]
    if len(spread) and float(np.max(spread * np.asarray(errors[: len(spread)]))) > LARGEST_ERROR:
        raise SeparatedData("a term's standard error has no bound")
    if iterations >= MAX_ITERATIONS:
        raise NotConverged(f"no convergence after {iterations} iterations")


def null_deviance(n: float, successes: float) -> float:
    """Deviance of the model with only an intercept."""
    return -2 * sum(k * math.log(k / n) for k in (successes, n - successes) if k > 0)


def deviance(rows: DataFrame, label: str, fit: LogitFit) -> float:
    """Deviance of the fitted model, one pass over the weighted rows."""
    score = F.col("score")
    # ln(1 + exp(s)) without overflow.
    softplus = F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score)))
    loss = F.col("_weight") * (softplus - F.col(term_name(label)) * score)
    return 2 * rows.withColumn("score", fit.score()).agg(F.sum(loss)).first()[0]


def model_design(
    features: DataFrame, spec: ModelSpec, factors: Sequence[Categorical], label: str = "bestanden"
) -> DataFrame:
    return design_matrix(features, label, [*DEMOGRAPHY, *spec.activity], factors)


def fit_model(
    features: DataFrame, spec: ModelSpec, factors: Sequence[Categorical], label: str = "bestanden"
) -> LogitFit:
    """One of the four models; without activity terms every term is discrete."""
    return logit_fit(model_design(features, spec, factors, label), label, not spec.activity)


def model_sums(design: DataFrame, models: Sequence[tuple[list[int], list[float]]]) -> list[np.ndarray]:
    """Per model (places of its terms among the columns after the label, and coefficients, the intercept first)
    the sums of one pass: second derivatives, first derivatives, deviance, rows and successes, in one vector.

    A row counts for a model if it has a label and all the model's terms. Each task sums its rows in dense
    matrix products and sends one row per number.
    """

    def sums(batches: Iterable) -> Iterator:
        # Sent to the workers as it is: nothing of this package is needed there.
        import numpy as np
        import pyarrow as pa

        totals = [np.zeros(len(beta) * (len(beta) + 1) + 3) for _, beta in models]
        for batch in batches:
            columns = [column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns]
            label = columns[0]
            for total, (places, beta) in zip(totals, models):
                terms = np.column_stack([np.ones(len(label)), *(columns[place + 1] for place in places)])
                whole = ~(np.isnan(terms).any(axis=1) | np.isnan(label))
                terms, y = terms[whole], label[whole]
                score = terms @ np.array(beta)
                mean = np.exp(-np.logaddexp(0, -score))
                second = terms.T @ (terms * (mean * (1 - mean))[:, None])
                deviance = 2 * (np.logaddexp(0, score) - y * score).sum()
                total += [*second.ravel(), *(terms.T @ (y - mean)), deviance, len(y), y.sum()]
        parts = [(m, np.arange(len(total)), total) for m, total in enumerate(totals)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(total), m, np.int32) for m, _, total in parts])),
                pa.array(np.concatenate([place.astype(np.int32) for _, place, _ in parts])),
                pa.array(np.concatenate([total for _, _, total in parts])),
            ],
            ["model", "place", "value"],
        )

    found = [np.zeros(len(beta) * (len(beta) + 1) + 3) for _, beta in models]
    summed = design.mapInArrow(sums, "model int, place int, value double").groupBy("model", "place")
    for row in summed.agg(F.sum("value").alias("value")).collect():
        found[row["model"]][row["place"]] = row["value"]
    return found


class Newton:
    """One model on its way to its fit: coefficients, and what the last pass said about them."""

    def __init__(self, terms: Sequence[str]) -> None:
        self.terms = list(terms)
        self.beta = np.zeros(len(terms) + 1)
        self.before, self.least = self.beta, math.inf
        self.fit: LogitFit | None = None
        self.passes = 0

    def take(self, sums: np.ndarray) -> None:
        """Use the sums of a pass with the present coefficients: settle, halve the step or take the next one."""
        k = len(self.beta)
        second, first = sums[: k * k].reshape(k, k), sums[k * k : k * k + k]
        deviance, n, successes = map(float, sums[k * k + k :])
        self.passes += 1
        if self.passes == 1:
            # Without coefficients every weight is a quarter, so this is the design's own cross product.
            self.gram = 4 * second
            if n == 0:
                raise SingularDesign("no rows")
            require_identifiable(self.gram, self.terms)
            self.null = null_deviance(n, successes)
        if deviance > self.least * (1 + 1e-9) and self.passes <= MAX_ITERATIONS:
            self.beta = (self.beta + self.before) / 2
            return
        if deviance < PERFECT_FIT * self.null:
            raise SeparatedData("the terms tell the outcomes apart without error")
        try:
            step = np.linalg.solve(second, first)
            errors = np.sqrt(np.diag(np.linalg.inv(second)))
        except np.linalg.LinAlgError:
            raise SeparatedData("the fit has no curvature left") from None
        spread = np.sqrt(np.maximum(np.diag(self.gram) / n - (self.gram[0] / n) ** 2, 0.0))
        settled = bool(np.all(np.abs(step) <= 1e-9 * np.maximum(1.0, np.abs(self.beta))))
        if (settled or self.passes > MAX_ITERATIONS) and float(np.max(spread * errors)) > LARGEST_ERROR:
            raise SeparatedData("a term's standard error has no bound")
        if settled:
            self.fit = LogitFit((INTERCEPT, *self.terms), tuple(self.beta.tolist()), tuple(errors.tolist()), deviance, self.null)
        elif self.passes > MAX_ITERATIONS:
            raise NotConverged(f"no convergence after {MAX_ITERATIONS} iterations")
        else:
            self.before, self.least, self.beta = self.beta, deviance, self.beta + step


def logit_fits(design: DataFrame, label: str, models: Mapping[str, Sequence[str]]) -> dict[str, LogitFit]:
    """Unregularised logits of ``label`` on several sets of the columns of ``design``, fitted together.

    A model is fitted on the rows that have the label (0 or 1) and all its terms. Raises what ``logit_fit``
    raises, if any model cannot be fitted.
    """
    terms = list(dict.fromkeys(term for chosen in models.values() for term in chosen))
    stored = cut_lineage(design.select(*[term_name(name) for name in (label, *terms)]).toDF(*[f"c{i}" for i in range(len(terms) + 1)]))
    runs = {name: Newton(chosen) for name, chosen in models.items()}
    while open_runs := [run for run in runs.values() if run.fit is None]:
        passed = [([terms.index(term) for term in run.terms], run.beta.tolist()) for run in open_runs]
        for run, sums in zip(open_runs, model_sums(stored, passed)):
            run.take(sums)
    return {name: run.fit for name, run in runs.items()}


def fit_models(
    features: DataFrame, specs: Sequence[ModelSpec], factors: Sequence[Categorical], label: str = "bestanden"
) -> dict[str, LogitFit]:
    """The models by title, fitted together on one stored design."""
    activity = list(dict.fromkeys(term for spec in specs for term in spec.activity))
    design = design_columns(features, label, [*DEMOGRAPHY, *activity], factors)
    shared = [name for name in design.columns if name != label and name not in activity]
    return logit_fits(design, label, {spec.title: [*shared, *spec.activity] for spec in specs})


def odds_ratios(spark: SparkSession, fit: LogitFit, digits: int | None = 3) -> DataFrame:
    """One row per term: odds ratio, 95 % confidence interval and p-value; unrounded without ``digits``."""

    def shown(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    rows = list(
        zip(range(len(fit.terms)), fit.terms, fit.coefficients, fit.standard_errors, fit.p_values)
    )
    table = spark.createDataFrame(rows, "position int, term string, b double, se double, p double")
    b, margin = F.col("b"), F.col("se") * Z_95
    return table.select(
        "position",
        "term",
        shown(F.exp(b)).alias("OR"),
        shown(F.exp(b - margin)).alias("ci_unten"),
        shown(F.exp(b + margin)).alias("ci_oben"),
        shown(F.col("p")).alias("p"),
    )


def pseudo_r2(fit: LogitFit, digits: int = 3) -> float:
    """McFadden's pseudo R²."""
    return round(1 - fit.deviance / fit.null_deviance, digits)


def effect_size(odds_ratio: Column) -> Column:
    label = F.lit(LARGEST_EFFECT)
    for bound, name in reversed(EFFECT_BANDS):
        label = F.when(odds_ratio < bound, name).otherwise(label)
    return label


def significance(p: Column) -> Column:
    stars = F.lit(NOT_SIGNIFICANT)
    for level, text in reversed(STARS):
        stars = F.when(p < level, text).otherwise(stars)
    return stars


def with_effect_size(table: DataFrame) -> DataFrame:
    """An unrounded odds ratio table with the size band of each effect and its significance stars.

    Rounding first would move values across the bounds.
    """
    return table.withColumns(
        {"effekt": effect_size(F.col("OR")), "signifikanz": significance(F.col("p"))}
    )


def forest_table(
    spark: SparkSession,
    fits: Mapping[str, LogitFit],
    labels: Mapping[str, str] = LABELS,
) -> DataFrame:
    """The data of a forest plot: per model title and term the odds ratio and its interval arms.

    Terms of a model are numbered from the bottom of the plot; the axis limits are shared.
    """
    tables = [
        odds_ratios(spark, fit)
        .where(F.col("term") != INTERCEPT)
        .select(
            F.lit(title).alias("modell"),
            (F.lit(len(fit.terms)) - F.col("position")).alias("zeile"),
            "term",
            "OR",
            "ci_unten",
            "ci_oben",
            "p",
        )
        for title, fit in fits.items()
    ]
    stacked = union_all(tables)
    limits = stacked.agg(
        (F.min("ci_unten") * 0.85).alias("x_min"), (F.max("ci_oben") * 1.15).alias("x_max")
    )
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("term")), F.col("term"))
    return stacked.select(
        "modell",
        "zeile",
        label.alias("bezeichnung"),
        "OR",
        F.round(F.col("OR") - F.col("ci_unten"), 3).alias("fehler_links"),
        F.round(F.col("ci_oben") - F.col("OR"), 3).alias("fehler_rechts"),
        F.when(F.col("p") < 0.05, 1).otherwise(0).alias("signifikant"),
        F.round(limits.select("x_min").scalar(), 4).alias("x_min"),
        F.round(limits.select("x_max").scalar(), 4).alias("x_max"),
    ).orderBy("modell", F.desc("zeile"))
