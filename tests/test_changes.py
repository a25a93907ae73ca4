"""References in one pass, keyed differences, refreshes of what changed, and the rank of a design."""

from __future__ import annotations

from collections import Counter
import os
from random import Random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import changes, identifiability, integrity, references, report, versions
from cohortlens.plans import queries
from cohortlens.session import scratch_path
from cohortlens.sources.schemas import Reference
from conftest import plan_of, tuples

REFS = (
    Reference("a_b", "a", "b", ("x", "y")),
    Reference("a_c", "a", "c", ("z",)),
    Reference("c_b", "c", "b", ("x", "y")),
    Reference("b_b", "b", "b", ("x", "y")),
)


def reference_tables(spark, a, b, c):
    return {
        "a": spark.createDataFrame(a, "x int, y string, z long, other string"),
        "b": spark.createDataFrame(b, "y string, x long"),
        "c": spark.createDataFrame(c, "z long, x int, y string"),
    }


def random_rows(seed=2, n=400):
    random = Random(seed)
    number = lambda: random.choice([None, *range(8)])
    text = lambda: random.choice([None, "", "p", "q"])
    a = [(number(), text(), number(), "o") for _ in range(n)] + [(1, "p", 99, "hot")] * 300
    return a, [(text(), number()) for _ in range(12)], [(number(), number(), text()) for _ in range(5)]


def test_references_equal_anti_joins(spark):
    for rows in (random_rows(), ([], [], []), (random_rows()[0], [], [])):
        tables = reference_tables(spark, *rows)
        got = {row["beziehung"]: (row["waisen"], row["schluessel"]) for row in references.reference_violations(tables, REFS).collect()}
        for ref in REFS:
            missing = integrity.orphan_keys(tables[ref.child], tables[ref.parent], ref.keys)
            expected = missing.agg(F.coalesce(F.sum("anzahl"), F.lit(0)), F.count("*")).first()
            assert got[ref.name] == tuple(expected)


def test_references_read_every_table_once_and_group_once(spark, tmp_path):
    tables = {}
    for name, df in reference_tables(spark, *random_rows()).items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    plan = plan_of(references.reference_violations(tables, REFS))
    assert plan.count("FileScan parquet") == 3 and plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "other" not in plan


OLD = [(1, None, "a", 1.5), (2, "k", None, 2.0), (None, "k", "same", None), (4, "gone", "x", 0.0), (6, "twice", "x", 0.0), (6, "twice", "y", 0.0)]
NEW = [(1, None, "", 1.5), (2, "k", "", 3.0), (None, "k", "same", None), (5, "new", "x", 0.0), (6, "twice", "x", 0.0)]


def test_changes_by_key(spark):
    schema = "id int, part string, text string, value double"
    old, new = spark.createDataFrame(OLD, schema), spark.createDataFrame(NEW, schema).withColumn("more", F.lit(1))
    got = Counter({(row["art"], row["spalte"]): row["anzahl"] for row in changes.table_changes(old, new, ["id", "part"]).collect()})
    assert got == {
        ("hinzugekommen", None): 1,
        ("entfallen", None): 1,
        ("geaendert", None): 2,
        ("schluessel_mehrfach", None): 1,
        ("spalte", "text"): 2,
        ("spalte", "value"): 1,
    }
    same = changes.table_changes(old, old, ["id", "part"]).where("anzahl > 0").collect()
    assert [(row["art"], row["anzahl"]) for row in same] == [("schluessel_mehrfach", 1)]
    nothing = changes.table_changes(old.limit(0), old.limit(0), ["id", "part"]).agg(F.sum("anzahl")).first()[0]
    assert nothing == 0


def test_only_keys_and_digests_are_shuffled(spark, tmp_path):
    spark.createDataFrame(OLD, "id int, part string, text string, value double").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(changes.key_states(stored, stored, ["id", "part"], ["text", "value"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def sources_of(spark, rows, more):
    return {
        "rows": spark.createDataFrame(rows, "module string, id int, v int"),
        "more": spark.createDataFrame(more, "module string, w int"),
    }


def build(sources):
    extra = sources["more"].groupBy("module").agg(F.sum("w").alias("w")).withColumnRenamed("module", "m")
    return sources["rows"].join(extra, F.col("module").eqNullSafe(F.col("m")), "left").drop("m")


def test_refresh_writes_only_changed_groups(spark):
    table, folder = f"stand_{uuid.uuid4().hex}", scratch_path(spark, "versions")
    rows = [(m, k, k) for m in ("a", "b", "", None) for k in range(4)]
    more = [("a", 1), ("b", 2), (None, 3)]

    def refresh(rows, more):
        sources = sources_of(spark, rows, more)
        listed = versions.refresh_changed(sources, build, table, folder, "module", ["module", "id"])
        like = build(sources)
        stored = versions.read_groups(listed, like)
        assert sorted(tuples(stored), key=repr) == sorted(tuples(like), key=repr)
        return {row["gruppe"]: (row["ordner"], row["neu"]) for row in listed.collect()}, stored

    try:
        first, held = refresh(rows, more)
        assert set(first) == {"a", "b", "", None} and all(new for _, new in first.values())
        before = sorted(tuples(held), key=repr)
        # The same rows in another order change nothing; nothing is built or written.
        again, _ = refresh(rows[::-1], more[::-1])
        assert {g: f for g, (f, _) in again.items()} == {g: f for g, (f, _) in first.items()}
        assert not any(new for _, new in again.values())
        # One source of one module, a repeated row that becomes another repetition, a new and a lost module.
        second, _ = refresh([r for r in rows if r[0] != ""] + [("c", 1, 1)], [("a", 1), ("b", 1), ("b", 1), (None, 3)])
        assert {g for g, (_, new) in second.items() if new} == {"b", "c"} and set(second) == {"a", "b", "c", None}
        assert second["a"][0] == first["a"][0] and second[None][0] == first[None][0]
        assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("version-")]) == 2
        # A reader of the first list still reads its files.
        assert sorted(tuples(held), key=repr) == before
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_refresh_refuses_repeated_keys_and_keeps_the_old_list(spark):
    table, folder = f"stand_{uuid.uuid4().hex}", scratch_path(spark, "versions")
    arguments = (build, table, folder, "module", ["module", "id"])
    try:
        good = versions.refresh_changed(sources_of(spark, [("a", 1, 1)], []), *arguments).collect()
        with pytest.raises(report.KeyViolation):
            versions.refresh_changed(sources_of(spark, [("a", 1, 1), ("a", 1, 2)], []), *arguments)
        assert versions.manifest(spark, table).collect() == good
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_a_refresh_by_modules_computes_its_sources_once(spark, folder, monkeypatch):
    """Submissions and enrolments are derived once for both refreshes, and the columns are read without rows."""
    built, derived = [], []

    def build(sources, run=queries.report_from):
        built.append(sources)
        return run(sources)

    def submissions(*args, run=queries.submissions):
        derived.append(args)
        return run(*args)

    monkeypatch.setattr(queries, "report_from", build)
    monkeypatch.setattr(queries, "submissions", submissions)
    assert len(queries.QUERIES["report_refreshed_modules"](spark, folder).collect()) == 5
    assert len(derived) == 1 and len(built) == 3
    assert all("Join" not in plan_of(df) for sources in built for df in sources.values())
    assert [any(not df.isEmpty() for df in sources.values()) for sources in built] == [True, True, False]


def test_refresh_of_nothing(spark):
    table, folder = f"stand_{uuid.uuid4().hex}", scratch_path(spark, "versions")
    try:
        empty = sources_of(spark, [], [])
        listed = versions.refresh_changed(empty, build, table, folder, "module", ["module", "id"])
        assert listed.collect() == [] and versions.read_groups(listed, build(empty)).collect() == []
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_rank_names_what_depends_on_what(spark):
    random = Random(8)
    rows = []
    for _ in range(300):
        a, b, c = random.random() * 1e6, random.random(), random.randint(0, 9)
        rows.append((a, b, float(c), 2 * a - 3 * b + 4, 0.0, 7.0, b * 1e-5))
    df = spark.createDataFrame(rows, "a double, b double, c double, mix double, zero double, flat double, small double")
    found = identifiability.rank_of(df, df.columns)
    assert found.independent == ("(Konstante)", "a", "b", "c") and found.rank == 4
    assert found.aliases["mix"] == pytest.approx({"(Konstante)": 4, "a": 2, "b": -3}, abs=1e-3)
    assert found.aliases["zero"] == {} and found.aliases["flat"] == {"(Konstante)": 7.0}
    assert found.aliases["small"] == pytest.approx({"b": 1e-5})
    matrix = np.array([[1.0, *row] for row in rows])
    assert np.linalg.matrix_rank(matrix / np.maximum(np.abs(matrix).max(axis=0), 1)) == found.rank
    reported = identifiability.identifiability_report(df.withColumn("g", F.lit("x")), ["a", "b", "flat"], "g").where("pruefung = 'rang'")
    assert tuples(reported) == [("rang", "flat", "(Konstante)", 3.0, 1)]


def test_rank_of_independent_and_empty_designs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (0.5, None), (3.0, 9.0)], "a double, b double")
    assert identifiability.rank_of(df, ["a", "b"]) == identifiability.Rank(("(Konstante)", "a", "b"), {})
    assert identifiability.rank_of(df.limit(0), ["a", "b"]).rank == 0
