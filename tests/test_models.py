from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features, identifiability, logit
from cohortlens.plans import queries as q
from conftest import column, tuples

REPORT = (
    "code_module string, gender string, age_band string, imd_band string, "
    "highest_education string, disability string, final_result string"
)


def test_model_base_missing_values(spark):
    rows = [
        ("BBB", "F", "0-35", "0-10%", "HE Qualification", "Y", "Pass"),
        ("BBB", None, None, "90-100%", "other", None, None),
        ("BBB", "M", "35-55", "10-20%", "No Formal quals", "N", "Withdrawn"),
        ("BBB", "M", "35-55", None, "No Formal quals", "N", "Fail"),
        ("BBB", "M", "35-55", "10-20", "No Formal quals", "N", "Fail"),
    ]
    base = features.model_base(spark.createDataFrame(rows, REPORT)).select(*features.MODEL_COLUMNS)
    assert tuples(base) == [(1, 1, "Studium", 0, 1, 1), (0, 10, None, 1, 0, 0)]


def test_z_scores(spark):
    rows = [("a", 0), ("a", 3), ("a", 20), ("b", 5), ("b", 5), ("c", 9), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "code_module string, klicks long")
    z = features.zscore_log1p(df, {"z": "klicks"})
    assert z.columns == ["code_module", "klicks", "z"] and z.count() == 8
    stats = {
        r["code_module"]: (r["m"], r["s"])
        for r in z.groupBy("code_module").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    }
    assert stats["a"][0] == pytest.approx(0, abs=1e-12) and stats["a"][1] == pytest.approx(1)
    assert stats[None][1] == pytest.approx(1)
    # No spread, and a single row.
    assert stats["b"] == (None, None) and stats["c"] == (None, None)


def test_fallback_without_broadcast_gives_the_same(spark, monkeypatch):
    df = spark.range(60).select(
        (F.col("id") % 7).cast("string").alias("code_module"), (F.col("id") % 11).alias("klicks")
    )
    expected = sorted(tuples(features.zscore_log1p(df, {"z": "klicks"})))
    monkeypatch.setattr(features, "small_side", lambda stats: stats)
    assert sorted(tuples(features.zscore_log1p(df, {"z": "klicks"}))) == expected


def test_design_matrix_codes_and_drops(spark):
    rows = [("DDD", 1, 0.5), ("BBB", 0, 1.0), ("ZZZ", 1, 1.0), (None, 1, 1.0), ("FFF", 1, None)]
    df = spark.createDataFrame(rows, "code_module string, y int, z double")
    factor = features.Categorical("code_module", ("BBB", "DDD", "FFF"), "BBB")
    design = features.design_matrix(df, "y", ["z"], [factor])
    assert design.columns == ["y", "code_module=DDD", "code_module=FFF", "z"]
    assert tuples(design) == [(1.0, 1.0, 0.0, 0.5), (0.0, 0.0, 0.0, 1.0)]


def test_levels_from_the_data(spark):
    df = spark.createDataFrame([("FFF",), ("BBB",), (None,), ("BBB",)], "code_module string")
    factor = features.categorical(df, "code_module")
    assert factor.levels == ("BBB", "FFF") and factor.reference == "BBB"
    assert features.categorical(df, "code_module", "FFF").contrasts == ["BBB"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 1)] * 30 + [(0, 1)] * 20 + [(1, 0)] * 10 + [(0, 0)] * 40
    return spark.createDataFrame(rows, "y int, x int").select(
        F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")
    )


@pytest.mark.parametrize("discrete", [True, False])
def test_closed_form(spark, table, discrete):
    fit = logit.logit_fit(table, "y", discrete)
    assert fit.terms == ("Intercept", "x")
    assert fit.coefficients == pytest.approx((-1.386294, 1.791759), abs=1e-6)
    assert fit.standard_errors[1] == pytest.approx(0.456435, abs=1e-6)
    assert logit.pseudo_r2(fit, 6) == 0.128236
    assert fit.p_values[1] == pytest.approx(math.erfc(1.791759 / 0.456435 / math.sqrt(2)), rel=1e-4)
    row = logit.odds_ratios(spark, fit).where("term = 'x'").first()
    half = 1.959963984540054 * 0.4564354645876384
    assert row["OR"] == 6.0
    assert row["ci_unten"] == round(6 * math.exp(-half), 3)
    assert row["ci_oben"] == round(6 * math.exp(half), 3)


def newton(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        information = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(information, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    log_likelihood = np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    return b, np.sqrt(np.diag(np.linalg.inv(information))), log_likelihood


@pytest.mark.parametrize("name", ["m1", "m2", "m4b"])
def test_against_newton(spark, folder, name):
    features_table = q.model_table(name, spark, folder)
    design = logit.model_design(features_table, q.model(name), q.factors())
    fit = logit.fit_model(features_table, q.model(name), q.factors())
    data = design.toPandas()
    y = data.pop("bestanden").to_numpy()
    b, se, log_likelihood = newton(data.to_numpy(), y)
    assert fit.coefficients == pytest.approx(b, abs=1e-6)
    assert fit.standard_errors == pytest.approx(se, abs=1e-6)
    assert fit.deviance == pytest.approx(-2 * log_likelihood, rel=1e-9)
    share = y.mean()
    null = len(y) * (share * math.log(share) + (1 - share) * math.log(1 - share))
    assert fit.null_deviance == pytest.approx(-2 * null, rel=1e-9)


def test_strong_effect_is_fitted(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.4 + 2.5 * z)))).astype(float)
    df = spark.createDataFrame(list(zip(y.tolist(), z.tolist())), "y double, z double")
    b, se, _ = newton(z[:, None], y)
    fit = logit.logit_fit(df, "y")
    assert fit.coefficients == pytest.approx(b, abs=1e-6)
    assert fit.standard_errors == pytest.approx(se, abs=1e-6)


@pytest.mark.parametrize(
    "extra, message",
    [("x", "not linearly independent"), ("x * 0", "always zero"), ("x * 0 + 1", "not linearly")],
)
def test_singular_design_is_refused(table, extra, message):
    design = table.select("y", "x", F.expr(extra).alias("copy"))
    with pytest.raises(identifiability.SingularDesign, match=message):
        logit.logit_fit(design, "y")


def test_module_without_spread_is_refused(spark):
    rows = [("a", i % 2, i) for i in range(20)] + [("b", i % 2, 4) for i in range(10)]
    df = spark.createDataFrame(rows, "code_module string, y int, klicks int")
    z = features.zscore_log1p(df, {"z": "klicks"})
    factor = features.Categorical("code_module", ("a", "b"), "a")
    with pytest.raises(identifiability.SingularDesign):
        logit.logit_fit(features.design_matrix(z, "y", ["z"], [factor]), "y")


def test_identifiability_report(spark):
    rows = [("B", 1.0, 2.0, 0.0), ("B", 2.0, 4.1, 3.0), ("D", 3.0, 6.0, 1.0), ("D", 5.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "code_module string, a double, b double, c double")
    found = {
        tuple(r)[:3]: r["auffaellig"]
        for r in identifiability.identifiability_report(df, ["a", "b", "c"], "code_module").collect()
    }
    assert found[("korrelation", "a", "b")] == 1
    assert found[("korrelation", "a", "c")] == 0
    assert found[("konstant", "c", "D")] == 1 and found[("konstant", "c", "B")] == 0


def test_labels_bands_and_stars(spark):
    df = spark.createDataFrame(
        [(1.67, 0.0004), (1.68, 0.005), (3.47, 0.03), (6.71, 0.05)], "OR double, p double"
    )
    labelled = logit.with_effect_size(df).select("effekt", "signifikanz")
    assert tuples(labelled) == [
        ("sehr klein", "***"),
        ("klein", "**"),
        ("mittel", "*"),
        ("groß", "n.s."),
    ]


def test_forest_table(spark, table):
    fit = logit.logit_fit(table, "y")
    rows = logit.forest_table(spark, {"Modell": fit}, {"x": "Merkmal"}).collect()
    assert [(r["zeile"], r["bezeichnung"], r["signifikant"]) for r in rows] == [(1, "Merkmal", 1)]
    low, high = 6.0 - rows[0]["fehler_links"], 6.0 + rows[0]["fehler_rechts"]
    assert rows[0]["x_min"] == pytest.approx(low * 0.85, abs=1e-3)
    assert rows[0]["x_max"] == pytest.approx(high * 1.15, abs=1e-3)


def test_group_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, -1.0)], "flag int, z double")
    assert tuples(features.group_mean(df, "flag", "z")) == [(0, 2, 1.5), (1, 1, -1.0)]
    assert column(features.group_mean(df, "flag", "z"), "anzahl") == [2, 1]


def test_labels_of_a_fit_use_unrounded_values(spark):
    def fit(odds_ratio, p):
        z = next(z / 1e4 for z in range(10_000, 60_000) if math.erfc(z / 1e4 / math.sqrt(2)) <= p)
        b = math.log(odds_ratio)
        return logit.LogitFit(("Intercept", "x"), (0.1, b), (1.0, b / z), 1.0, 2.0)

    for odds_ratio, p, labels in (
        (1.6796, 0.0007, ("sehr klein", "***")),
        (1.6804, 0.0097, ("klein", "**")),
        (6.7096, 0.0497, ("mittel", "*")),
    ):
        table = logit.odds_ratios(spark, fit(odds_ratio, p), digits=None)
        labelled = logit.with_effect_size(table).where("term = 'x'").select("effekt", "signifikanz")
        assert tuples(labelled) == [labels]


def test_separated_data_are_refused(spark):
    df = spark.range(200).select(
        (F.col("id") >= 100).cast("double").alias("y"), F.col("id").cast("double").alias("x")
    )
    with pytest.raises(logit.SeparatedData):
        logit.logit_fit(df, "y")
    quasi = df.withColumn("x", (F.col("x") >= 150).cast("double"))
    with pytest.raises(logit.SeparatedData):
        logit.logit_fit(quasi, "y", discrete=True)


def test_a_factor_may_have_many_levels(spark):
    df = spark.range(450).select(
        (F.col("id") % 2).cast("double").alias("y"), F.format_string("%03d", F.col("id") % 150).alias("m")
    )
    factor = features.categorical(df, "m")
    assert len(factor.levels) == 150
    assert len(features.design_matrix(df, "y", [], [factor]).columns) == 150


def random_design(spark, n=3000, seed=1):
    generator = np.random.default_rng(seed)
    x = generator.normal(size=(n, 3)) * [1.0, 20.0, 0.01]
    p = 1 / (1 + np.exp(-(0.3 + x @ [0.8, -0.05, 40.0])))
    y = (generator.random(n) < p).astype(float)
    rows = [(float(b), *map(float, a), None if k % 7 == 0 else float(a[0] * a[1])) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0)], "y double, a double, `b=b` double, c double, d double")


def test_models_fitted_together_equal_single_fits(spark):
    design = random_design(spark)
    models = {"one": ["a"], "all": ["a", "b=b", "c", "d"], "none": [], "two": ["c", "a"]}
    fits = logit.logit_fits(design, "y", models)
    for name in ("one", "all", "two"):
        whole = design.select("y", *[f"`{term}`" for term in models[name]]).dropna()
        single = logit.logit_fit(whole, "y")
        assert fits[name].terms == single.terms
        for part in ("coefficients", "standard_errors", "p_values"):
            assert getattr(fits[name], part) == pytest.approx(getattr(single, part), rel=1e-5, abs=1e-9)
        assert fits[name].deviance == pytest.approx(single.deviance) and fits[name].null_deviance == pytest.approx(single.null_deviance)
    assert fits["none"].deviance == pytest.approx(fits["none"].null_deviance)


def test_passes_do_not_grow_with_models(spark, monkeypatch):
    passes = []
    whole = logit.model_sums
    monkeypatch.setattr(logit, "model_sums", lambda design, models: passes.append(len(models)) or whole(design, models))
    design = random_design(spark)
    logit.logit_fits(design, "y", {"all": ["a", "b=b", "c"]})
    alone = len(passes)
    passes.clear()
    logit.logit_fits(design, "y", {str(k): ["a", "b=b", "c"][: 1 + k % 3] for k in range(9)})
    assert len(passes) <= alone + 1 and passes[0] == 9


@pytest.mark.parametrize(
    "rows, error",
    [
        ([(1.0, 1.0, 2.0), (0.0, 2.0, 4.0), (1.0, 3.0, 6.0), (0.0, 5.0, 10.0)], identifiability.SingularDesign),
        ([(0.0, 1.0, 0.0), (0.0, 2.0, 1.0), (1.0, 3.0, 0.0), (1.0, 4.0, 1.0), (1.0, 5.0, 1.0)], logit.SeparatedData),
        ([(1.0, 1.0, 0.5), (1.0, 2.0, 3.0), (1.0, 4.0, 1.0), (1.0, 3.0, 0.0)], logit.SeparatedData),
        ([], identifiability.SingularDesign),
    ],
)
def test_models_without_a_fit_are_refused_together(spark, rows, error):
    design = spark.createDataFrame(rows, "y double, a double, b double")
    with pytest.raises(error):
        logit.logit_fits(design, "y", {"m": ["a", "b"]})
