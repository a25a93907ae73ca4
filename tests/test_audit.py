from __future__ import annotations

import pytest

from cohortlens.functions.text import DECIMAL
from cohortlens.operators import audit, integrity, scorecard
from cohortlens.sources import schemas as S
from conftest import tuples


@pytest.fixture(scope="module")
def values(spark):
    rows = [("a", "1"), ("a", None), ("a", ""), ("b", "?"), ("b", "78.5"), ("b", "7\n"), (None, "?")]
    return spark.createDataFrame(rows, "k string, v string")


def test_three_rules_for_null(values):
    assert tuples(audit.invalid_format_count(values, "v")) == [(5,)]
    assert tuples(audit.invalid_format_count(values, "v", DECIMAL)) == [(4,)]
    assert tuples(audit.missing_by_type(values, "v", "k")) == [("a", 2), ("b", 3), (None, 1)]
    assert tuples(audit.placeholder_counts(values, "v", "k")) == [("a", 3, 1), ("b", 3, 1), (None, 1, 1)]
    assert tuples(audit.missing_by_group(values, "v", "k")) == [("b", 1), (None, 1)]


def test_numeric_profile(spark):
    rows = [("x", "1"), ("x", "4"), ("x", "?"), ("y", "7"), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v string")
    # One value has no standard deviation, and NULL sorts first when descending.
    assert tuples(audit.numeric_profile(df, "v", group="g")) == [
        ("y", 7.0, 7.0, 7.0, None),
        ("x", 1.0, 4.0, 2.5, 2.1),
    ]
    assert tuples(audit.numeric_profile(df, "v")) == [(1.0, 7.0, 4.0, 3.0)]


def test_outlier_buckets(spark):
    clicks = ["100", "101", "500", "501", "1000", "1001", "2000", "2001", "?", "-5", "500.5", None]
    df = spark.createDataFrame([(c,) for c in clicks], "c string")
    buckets = (("100-500", 100, 500), ("501-1000", 501, 1000), ("1001-2000", 1001, 2000))
    assert tuples(audit.outlier_buckets(df, "c", 100, buckets, "ueber 2000")) == [
        ("100-500", 2),
        ("501-1000", 2),
        ("1001-2000", 2),
        ("ueber 2000", 1),
    ]
    assert tuples(audit.outlier_count(df, "c", 100)) == [(7,)]


def test_buckets_sum_to_outlier_count(spark, folder):
    from cohortlens.plans.queries import QUERIES

    total = QUERIES["outlier_count"](spark, folder).first()[0]
    assert sum(r["anzahl"] for r in QUERIES["outlier_buckets"](spark, folder).collect()) == total


def test_duplicates_domain_and_whitespace(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (" b", 2), (None, 3), (None, 3)], "k string, n int")
    assert sorted(tuples(audit.duplicate_keys(df, ["k", "n"])), key=str) == [("a", 1, 2), (None, 3, 2)]
    assert tuples(audit.category_domain(df, "k")) == [(" b",), ("a",), (None,)]
    assert tuples(audit.whitespace_values(df, "k")) == [(" b",)]
    assert tuples(audit.distinct_profile(df, "k", {"n": "n"})) == [(" b", 1), ("a", 1), (None, 1)]


def test_shared_passes_equal_single_checks(values):
    audited = audit.numeric_audit(values, "v", 0).first()
    assert (audited["zeilen"], audited["ungueltig"], audited["ausreisser"]) == (7, 5, 1)
    assert tuples(audit.category_domains(values, ["v", "k"])) == [
        ("k", "a"), ("k", "b"), ("k", None), ("v", ""), ("v", "1"), ("v", "7\n"), ("v", "78.5"), ("v", "?"), ("v", None),
    ]
    assert tuples(audit.whitespace_domains(values, ["v", "k"])) == []


def test_orphans_and_null_keys(spark):
    child = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (3, None)], "a int, b string")
    parent = spark.createDataFrame([(2, "x"), (3, "y")], "a int, b string")
    assert tuples(integrity.orphan_keys(child, parent, ["a", "b"])) == [(1, "x", 2)]
    assert tuples(integrity.orphans(child, parent, ["a", "b"])) == [(2,)]
    assert tuples(integrity.orphans(parent, parent, ["a", "b"])) == [(0,)]


def test_pk_violations(spark):
    rows = [("B", "J", 1), ("B", "J", 1), ("B", "J", 2), (None, "J", 3), (None, "J", 3)]
    df = spark.createDataFrame(rows, "code_module string, code_presentation string, id_student int")
    spec = S.TableSpec("t", (), S.ENROLMENT)
    assert tuples(integrity.pk_violations({"t": df}, [spec])) == [("t", 1, 2)]


def test_reconcile(spark):
    one, two = spark.range(1), spark.range(2)
    result = integrity.row_reconcile([("a", two, two), ("b", two, one)])
    assert sorted(tuples(result)) == [("a", 2, 2), ("b", 2, 1)]


def test_domain_checks(spark):
    scores = spark.createDataFrame(
        [(101.0, 0), (39.5, 1), (40.0, 2), (None, None), (-1.0, 0)], "score double, is_banked int"
    )
    assert tuples(integrity.score_domain_check(scores)) == [(5, 2, 2, 1)]
    exams = spark.createDataFrame(
        [("B", "J", "TMA", 60.0), ("B", "J", "CMA", 40.0), ("B", "J", "Exam", 100.0), ("D", "J", "Exam", 100.0)],
        "code_module string, code_presentation string, assessment_type string, weight double",
    )
    assert tuples(integrity.weight_sum_check(exams)) == [("B", "J", 100.0, 1), ("D", "J", 0.0, 0)]


def test_scorecard_grades_and_inner_join(spark):
    figures = spark.createDataFrame(
        [("AAA", 712, 2, 10, 0, 4, 5), ("BBB", 7692, 4, 742, 63, 4, 12), ("CCC", 2000, 3, 350, 300, 3, 10)],
        "code_module string, gruppengroesse long, anzahl_praesentationen long, disability_faelle long, "
        "fehlende_imd_werte long, anzahl_ergebnistypen long, anzahl_activity_types long",
    )
    spread = spark.createDataFrame([("BBB", 20.2), ("AAA", None)], "code_module string, score_streuung double")
    card = scorecard.group_scorecard(
        [figures, spread], "code_module", verdicts={"BBB": "AUSGEWAEHLT"}, first=["BBB"]
    )
    # CCC has no scores and drops out with the inner join.
    assert tuples(card) == [
        ("BBB", "+", "+", "+", "o", "+", "+", "+", "AUSGEWAEHLT"),
        ("AAA", "-", "o", "-", "-", "-", "+", "+", ""),
    ]


@pytest.mark.parametrize("long", ["123456789012345", "1234567890123456789"])
def test_long_numbers_give_the_same_figures(spark, long):
    df = spark.createDataFrame([("1",), (long,), ("?",)], "v string")
    number = float(int(long))
    assert tuples(audit.numeric_profile(df, "v").select("minimum", "maximum")) == [(1.0, number)]
    row = audit.numeric_audit(df, "v", 100).first()
    assert (row["minimum"], row["maximum"], row["ausreisser"], row["ungueltig"]) == (1.0, number, 1, 1)
    assert row["durchschnitt"] == audit.numeric_profile(df, "v").first()["durchschnitt"] == (int(long) + 1) / 2
    assert tuples(audit.outlier_count(df, "v", 100)) == [(1,)]
