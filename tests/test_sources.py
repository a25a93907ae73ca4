from __future__ import annotations

import os

import pytest

from cohortlens.sources import csvfiles, tables
from cohortlens.sources import schemas as S
from conftest import tuples


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_null_empty_quotes_and_newlines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b,c\n1,,x\n2,"","say ""hi"""\n3,"two\nlines",\\"\n')
    rows = tuples(csvfiles.load_text_csv(spark, path, ["a", "b", "c"], quoted_newlines=True))
    assert rows == [
        ("1", None, "x"),
        ("2", "", 'say "hi"'),
        ("3", "two\nlines", '\\"'),
    ]


@pytest.mark.parametrize("text", ["a,b\n1\n", "a,b\n1,2,3\n", "a,x\n1,2\n"])
def test_malformed_file_fails(spark, tmp_path, text):
    path = write(tmp_path / "a.csv", text)
    with pytest.raises(Exception):
        csvfiles.load_text_csv(spark, path, ["a", "b"]).collect()


def test_raw_tables_load_as_text(spark, tmp_path):
    for name, file in S.RAW_FILES.items():
        names = S.TABLES[name].names
        write(tmp_path / file, ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    loaded = csvfiles.load_raw_tables(spark, str(tmp_path))
    assert set(loaded) == set(S.TABLES)
    for name, df in loaded.items():
        assert df.schema == S.TABLES[name].raw_schema
        assert df.collect()[0][0] == "1"


def test_export_round_trip(spark, tmp_path):
    rows = [("BBB", "2013J", 1, 'quote " here', 5), ("BBB", None, 2, "", 6)]
    df = spark.createDataFrame(rows, S.TYPE_EXPORT)
    path = csvfiles.export_csv(df, str(tmp_path / "out"))
    text = csvfiles.load_text_csv(spark, path, df.columns)
    assert sorted(tuples(text), key=str) == sorted(
        [("BBB", "2013J", "1", 'quote " here', "5"), ("BBB", None, "2", "", "6")], key=str
    )
    typed = csvfiles.read_export(spark, path, S.TYPE_EXPORT)
    assert [r["klicks"] for r in typed.orderBy("klicks").collect()] == [5, 6]
    with pytest.raises(Exception):
        csvfiles.export_csv(df, path)


def test_rebuild_is_repeatable(spark, tmp_path):
    root = str(tmp_path)
    for clicks in (1, 2):
        tables.create_databases(spark, root)
        tables.rebuild_database(spark, "cleaned", root)
        df = spark.createDataFrame([("BBB", clicks), ("DDD", clicks)], "code_module string, n int")
        tables.write_tables({"student_vle": df}, "cleaned", {"student_vle": "code_module"})
        stored = tables.read_tables(spark, "cleaned", ["student_vle"])["student_vle"]
        assert sorted(tuples(stored)) == [(clicks, "BBB"), (clicks, "DDD")]
    assert any(n.startswith("code_module=BBB") for n in os.listdir(f"{root}/cleaned/student_vle"))
    for name in tables.DATABASES:
        spark.sql(f"DROP DATABASE {name} CASCADE")
