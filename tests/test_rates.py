from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.numeric import percent, ratio, rounded
from cohortlens.operators import rates, shares
from conftest import column, tuples


@pytest.fixture(scope="module")
def enrolments(spark):
    rows = [
        ("BBB", 1, "a", "Y", "Pass"),
        ("BBB", 1, "b", "N", "Fail"),
        ("BBB", 2, None, "N", "Withdrawn"),
        ("DDD", 3, "b", "N", "Distinction"),
        ("DDD", 4, "c", "Y", "Withdrawn"),
        (None, 5, "a", "N", None),
    ]
    return spark.createDataFrame(
        rows,
        "code_module string, id_student int, band string, disability string, final_result string",
    )


@pytest.mark.parametrize("n, t, expected", [(1, 2000, 0.1), (49, 400, 12.3), (0, 7, 0.0), (1, 0, None)])
def test_percent_ties(spark, n, t, expected):
    df = spark.createDataFrame([(n, t)], "n long, t long")
    assert column(df.select(percent(F.col("n"), F.col("t")).alias("p")), "p") == [expected]


def test_half_away_from_zero(spark):
    df = spark.sql("SELECT CAST(-0.25 AS DECIMAL(38,18)) AS v, CAST(1 AS DECIMAL(38,18)) AS one")
    row = df.select(
        rounded(F.col("v"), 1).alias("r"), ratio(F.col("one"), F.col("one") - 1).alias("q")
    ).first()
    assert tuple(row) == (-0.3, None)


def test_shares_with_null_group_and_category(enrolments):
    assert tuples(shares.share_within_group(enrolments, "code_module", "band")) == [
        ("BBB", "a", 1, 33.3),
        ("BBB", "b", 1, 33.3),
        ("BBB", None, 1, 33.3),
        ("DDD", "b", 1, 50.0),
        ("DDD", "c", 1, 50.0),
        (None, "a", 1, 100.0),
    ]


def test_side_by_side_with_absent_module(enrolments):
    table = shares.side_by_side_share(
        enrolments, "band", ["BBB", "XXX"], null_label="fehlend", order=["b", "a"]
    )
    assert tuples(table) == [
        ("b", 1, 33.3, 0, None),
        ("a", 1, 33.3, 0, None),
        ("c", 0, 0.0, 0, None),
        ("fehlend", 1, 33.3, 0, None),
    ]


def test_shares_add_up(spark, folder):
    from cohortlens.plans.queries import QUERIES

    sums = QUERIES["share_within_group"](spark, folder).groupBy("code_module").agg(F.sum("prozent"))
    assert all(abs(total - 100) < 0.3 for _, total in tuples(sums))


def test_rates_on_both_bases(enrolments):
    assert tuples(rates.outcome_rate(enrolments, ["code_module"], withdrawal=True)) == [
        ("BBB", 3, 33.3, 2, 33.3, 50.0),
        ("DDD", 2, 50.0, 1, 50.0, 100.0),
        (None, 1, 0.0, 0, 0.0, None),
    ]


def test_side_by_side_rates_guard_zero(enrolments):
    assert tuples(rates.side_by_side_rate(enrolments, "band", ["BBB", "DDD"], "fehlend")) == [
        ("a", 100.0, 100.0, None, None),
        ("b", 0.0, 0.0, 100.0, 100.0),
        ("c", None, None, 0.0, None),
        ("fehlend", 0.0, None, None, None),
    ]
    assert tuples(rates.side_by_side_withdrawal(enrolments, "band", ["DDD"])) == [
        ("a", None),
        ("b", 0.0),
        ("c", 100.0),
        (None, None),
    ]


def test_gap_and_gradient(enrolments):
    assert tuples(rates.rate_gap(enrolments, "code_module", "disability")) == [
        ("BBB", -100.0, -100.0),
        ("DDD", 100.0, None),
        (None, None, None),
    ]
    gradient = rates.band_gradient(enrolments.where("code_module = 'BBB'"), "band", "a", "b")
    assert tuples(gradient) == [("BBB", 100.0, 100.0, 0.0, 0.0, 0.0, 0.0)]


def test_repeats_and_lookup(spark, enrolments):
    assert tuples(shares.repeat_enrolments(enrolments, "code_module", "id_student")) == [("BBB", 1, 2)]
    assert tuples(shares.enrolments_vs_persons(enrolments, "code_module", "id_student")) == [
        ("BBB", 3, 2),
        ("DDD", 2, 2),
        (None, 1, 1),
    ]
    assert tuples(shares.conditional_share(enrolments, "band", F.col("disability") == "Y", "p")) == [
        ("a", 2, 50.0),
        ("b", 2, 0.0),
        ("c", 1, 100.0),
    ]
    assert tuples(shares.flag_share(enrolments, "code_module", "disability"))[0] == ("BBB", 3, 1, 33.3)
