from __future__ import annotations

from decimal import Decimal

import pytest

from cohortlens.operators import consistency, report, usage
from cohortlens.sources import schemas as S
from conftest import plan_of, tuples

KEY = "code_module string, code_presentation string, id_student int"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("B", "J", 1, 10, 0, 5),
        ("B", "J", 1, 10, 0, 5),
        ("B", "J", 1, 10, 0, 5),
        ("B", "J", 1, 11, 27, 2),
        ("B", "J", 1, 11, 28, 4),
        ("B", "J", 2, 11, -3, 9),
        ("B", "J", 2, 12, 5, 1),
        ("B", "J", 3, 99, 1, 7),
        ("D", "J", 4, 10, 3, None),
    ]
    return spark.createDataFrame(rows, KEY + ", id_site int, date int, sum_click int")


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(10, "quiz"), (11, "forumng"), (12, "homepage")]
    return spark.createDataFrame(rows, "id_site int, activity_type string")


@pytest.fixture(scope="module")
def enrolments(spark):
    rows = [
        ("B", "J", 1, "M", "0-35", "a", "x", "N", "Pass"),
        ("B", "J", 2, "F", "0-35", None, "x", "N", "Fail"),
        ("B", "J", 3, "F", "0-35", "a", "x", "Y", "Withdrawn"),
        ("B", "J", 5, "F", "0-35", "a", "x", "Y", None),
        ("D", "J", 4, "M", "55<=", "b", "x", "N", "Distinction"),
    ]
    return spark.createDataFrame(
        rows,
        KEY + ", gender string, age_band string, imd_band string, highest_education string, "
        "disability string, final_result string",
    )


def test_days_are_counted_once(events):
    assert sorted(tuples(usage.clicks_from_start(events))) == [
        ("B", "J", 1, 21, 3),
        ("B", "J", 2, 1, 1),
        ("B", "J", 3, 7, 1),
        ("D", "J", 4, None, 1),
    ]
    assert sorted(tuples(usage.early_clicks(events)))[0] == ("B", "J", 1, 17)


def test_profile_equals_the_single_tables(events, sites):
    types = ["quiz", "forumng", "homepage"]
    profile = {tuple(r)[:3]: tuple(r)[3:] for r in usage.activity_profile(events, sites, types).collect()}
    assert profile[("B", "J", 1)] == (21, 17, 15, 6, None)
    assert profile[("B", "J", 3)] == (7, 7, None, None, None)
    wide = usage.clicks_by_type_wide(usage.usage_per_entity(events, sites, since=0), types)
    assert sorted(tuples(wide))[0] == ("B", "J", 1, 15.0, 6.0, 0.0)


def test_top_usage_breaks_ties_by_name(spark, events, sites, enrolments):
    tied = events.where("id_student <= 2 AND (sum_click <> 4 OR date < 0)")
    top = tuples(usage.top_usage(tied, sites, enrolments, n=2))
    assert top == [
        ("B", "quiz", 15, 55.6, 25.0, 1),
        ("B", "forumng", 11, 40.7, 50.0, 2),
    ]
    equal = spark.createDataFrame(
        [("B", "J", 1, 11, 0, 3), ("B", "J", 1, 10, 0, 3)], KEY + ", id_site int, date int, sum_click int"
    )
    assert [r[1] for r in tuples(usage.top_usage(equal, sites, enrolments, n=1))] == ["forumng"]


def test_ratio_without_failures_or_clicks(spark, enrolments):
    used = spark.createDataFrame(
        [("B", "J", 1, "quiz", 10), ("B", "J", 2, "quiz", 0), ("D", "J", 4, "quiz", 3), ("B", "J", 3, "quiz", 99)],
        KEY + ", activity_type string, klicks long",
    )
    assert tuples(usage.outcome_usage_ratio(used, enrolments, ["quiz"])) == [
        ("B", "quiz", 10.0, 0.0, None),
        ("D", "quiz", 3.0, None, None),
    ]


def test_submissions_ignore_missing_scores_in_the_mean(spark):
    submitted = spark.createDataFrame(
        [(1, 7, Decimal("50.00")), (2, 7, None), (3, 7, Decimal("50.50")), (1, 8, None)],
        "id_assessment int, id_student int, score decimal(5,2)",
    )
    exams = spark.createDataFrame(
        [(1, "B", "J"), (2, "B", "J"), (3, "B", "J")],
        "id_assessment int, code_module string, code_presentation string",
    )
    assert sorted(tuples(usage.submissions(submitted, exams))) == [("B", "J", 7, 3, 50.3), ("B", "J", 8, 1, None)]


@pytest.fixture(scope="module")
def parts(spark, events, enrolments):
    none = spark.createDataFrame([], KEY + ", abgaben long, score_durchschnitt double")
    return enrolments, usage.clicks_from_start(events), none


def test_report_keeps_everyone(parts):
    rows = {r["id_student"]: r for r in report.enrolment_report(*parts).collect()}
    assert len(rows) == 5
    assert rows[5]["klicks_gesamt"] == rows[5]["aktive_tage"] == rows[5]["abgaben"] == 0
    assert rows[5]["bestanden"] == 0 and rows[1]["bestanden"] == 1
    # The mean of B includes the one without clicks and the withdrawn one: 29 / 4 = 7.25.
    assert rows[1]["klicks_diff_vom_modulschnitt"] == 13.8
    assert rows[3]["klicks_diff_vom_modulschnitt"] == -0.3
    assert rows[4]["score_durchschnitt"] is None


def test_view_equals_stored(parts):
    diff = report.report_diff(report.report_view(*parts), report.enrolment_report(*parts))
    assert tuples(diff) == [(0, 0, 0, 0)]


def test_deviation_does_not_shuffle_enrolments_by_module(parts):
    plan = plan_of(report.enrolment_report(*parts))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_store_refresh_and_diff(spark, tmp_path, parts):
    folder = str(tmp_path)
    full = report.enrolment_report(*parts)
    stored = report.materialise(full, "bericht_test", folder)
    assert tuples(report.report_diff(full, stored)) == [(0, 0, 0, 0)]
    assert tuples(report.report_counts(stored)) == [("B", 4, 1), ("D", 1, 1)]
    assert tuples(report.mean_clicks(stored)) == [("B", 7.3), ("D", 0.0)]
    newer = full.where("id_student <> 5")
    assert tuples(report.report_diff(newer, stored)) == [(0, 1, 0, 1)]
    refreshed = report.refresh(newer, "bericht_test", folder)
    assert tuples(report.report_diff(newer, refreshed)) == [(0, 0, 0, 0)]
    assert spark.table("bericht_test").count() == 4
    again = report.materialise(full, "bericht_test", folder)
    assert again.count() == 5
    spark.sql("DROP TABLE bericht_test")


def test_refresh_may_read_the_table_itself(spark, tmp_path, parts):
    folder = str(tmp_path)
    stored = report.materialise(report.enrolment_report(*parts), "bericht_selbst", folder)
    refreshed = report.refresh(stored.where("code_module = 'B'"), "bericht_selbst", folder)
    assert refreshed.count() == 4
    spark.sql("DROP TABLE bericht_selbst")


def test_repeated_key_is_refused(spark, tmp_path, parts):
    full = report.enrolment_report(*parts)
    with pytest.raises(report.KeyViolation):
        report.materialise(full.unionAll(full.limit(1)), "bericht_doppelt", str(tmp_path))


def test_diff_counts_repetitions(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    right = spark.createDataFrame([(1, None), (3, "y")], "a int, b string")
    assert tuples(report.report_diff(left, right)) == [(1, 1, 2, 1)]
    assert left.subtract(right).count() == 1 and left.exceptAll(right).count() == 2


def test_view_follows_its_tables(spark, tmp_path, parts):
    from cohortlens.sources.tables import create_view

    path = str(tmp_path / "enrolments")
    enrolments, clicks, submitted = parts
    enrolments.where("code_module = 'D'").write.parquet(path)
    read = lambda: report.report_view(spark.read.parquet(path), clicks, submitted)
    assert create_view(spark, "bericht_sicht", read).count() == 1
    enrolments.where("code_module = 'B'").write.mode("append").parquet(path)
    assert create_view(spark, "bericht_sicht", read).count() == 5
    assert spark.table("bericht_sicht").count() == 5


def test_consistency_of_assessments(spark):
    scores = [(1, s) for s in (50, 60, 10, None)] + [(2, s) for s in (39, 12, 40, 90, 80)] + [(3, 100)] * 4 + [(9, 50)]
    submitted = spark.createDataFrame([(k, n, s) for n, (k, s) in enumerate(scores)], "id_assessment int, id_student int, score int")
    rows = [("m", "p", 1), ("m", "p", 2), ("m", "p", 3), ("m", "q", 9), ("m", "p", 5)]
    exams = spark.createDataFrame(rows, "code_module string, code_presentation string, id_assessment int")
    counts = consistency.pass_counts(submitted, exams)
    assert sorted(tuples(counts.select("id_assessment", "n", "bestanden"))) == [(1, 3, 2), (2, 5, 3), (3, 4, 4), (9, 1, 1)]

    def chi_square(table):
        n, columns = sum(map(sum, table)), [sum(column) for column in zip(*table)]
        expected = [[sum(row) * column / n for column in columns] for row in table]
        return sum((o - e) ** 2 / e for r, w in zip(table, expected) for o, e in zip(r, w) if e)

    tables = {(1, 2): [(2, 1), (3, 2)], (1, 3): [(2, 1), (4, 0)], (2, 3): [(3, 2), (4, 0)]}
    got = {(r["pruefung_a"], r["pruefung_b"]): (r["abgaben"], r["chi_quadrat"], r["cramers_v"]) for r in consistency.pair_consistency(counts).collect()}
    assert set(got) == set(tables)
    for pair, table in tables.items():
        n = sum(map(sum, table))
        assert got[pair] == pytest.approx((n, chi_square(table), (chi_square(table) / n) ** 0.5), abs=1e-6)
    group = consistency.group_consistency(counts).first()
    whole = chi_square([(2, 1), (3, 2), (4, 0), (1, 0)])
    assert tuple(group) == ("m", 4, 13, pytest.approx(whole, abs=1e-6), 3, pytest.approx((whole / 13) ** 0.5, abs=1e-6))
    all_passed = counts.where("id_assessment IN (3, 9)")
    assert consistency.group_consistency(all_passed).first()["chi_quadrat"] == 0
    assert consistency.group_consistency(counts.limit(0)).collect() == []


def test_pairs_are_made_in_order_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Several courses, one of them with most assessments; repeated and NULL ids as in a plain join."""
    monkeypatch.setattr(consistency, "TASK_PAIRS", 50)
    rows = [("A", "1", k % 37, 20 + k % 5, k % 13) for k in range(60)]
    rows += [("B", "1", k, 10, k) for k in range(9)] + [("B", None, 3, 5, 2), ("A", "1", None, 4, 1), ("C", "2", 1, 9, 9)]
    counts = spark.createDataFrame(rows, "code_module string, code_presentation string, id_assessment long, n long, bestanden long")
    df = consistency.pair_consistency(counts)
    got = [(r["code_module"], r["pruefung_a"], r["pruefung_b"], r["abgaben"]) for r in df.collect()]
    known = [row for row in rows if row[1] is not None and row[2] is not None]
    wanted = [(x[0], x[2], y[2], x[3] + y[3]) for x in known for y in known if x[:2] == y[:2] and x[2] < y[2]]
    assert sorted(got) == sorted(wanted) and [g[:3] for g in got] == sorted(g[:3] for g in got)
    final = plan_of(df).split("== Initial Plan ==")[0]
    above = final[: final.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "Sort [" in above
    assert consistency.pair_consistency(counts.limit(0)).collect() == []
