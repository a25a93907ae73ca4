from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.operators import clean
from cohortlens.plans.queries import raw_tables, specs
from cohortlens.sources import schemas as S
from cohortlens.sources import standins
from conftest import column, tuples

EDGE = ["42", "42\n", " 42 ", "-5", "78.5", "?", "", None]


@pytest.mark.parametrize(
    "pattern, type, expected",
    [
        (text.UNSIGNED, "int", [42, None, None, None, None, None, None, None]),
        (text.SIGNED, "int", [42, None, None, -5, None, None, None, None]),
        (
            text.DECIMAL,
            "decimal(5,2)",
            [Decimal("42.00"), None, None, None, Decimal("78.50"), None, None, None],
        ),
    ],
)
def test_format_decides_then_casts(spark, pattern, type, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGE)], "i int, v string")
    spec = S.TableSpec("t", (S.ColumnSpec("i", "int"), S.ColumnSpec("v", type, pattern)))
    assert column(clean.clean(df, spec).orderBy("i"), "v") == expected


@pytest.mark.parametrize(
    "value, spec",
    [
        ("99999999999", S.ColumnSpec("v", "int", text.UNSIGNED)),
        ("1234.5", S.ColumnSpec("v", "decimal(5,2)", text.DECIMAL)),
        ("?", S.ColumnSpec("v", "int")),
        ("12345678901", S.ColumnSpec("v", "varchar(10)")),
    ],
)
def test_value_that_does_not_fit_fails(spark, value, spec):
    df = spark.createDataFrame([(value,)], "v string")
    with pytest.raises(Exception, match="CAST|OVERFLOW|NUMERIC|longer than"):
        clean.clean(df, S.TableSpec("t", (spec,))).collect()


def test_decimal_is_rounded_half_up(spark):
    df = spark.createDataFrame([("78.456",)], "v string")
    spec = S.TableSpec("t", (S.ColumnSpec("v", "decimal(5,2)", text.DECIMAL),))
    assert column(clean.clean(df, spec), "v") == [Decimal("78.46")]


def test_band_is_recoded(spark):
    df = spark.createDataFrame([("?",), ("10-20",), ("0-10%",), (None,)], "imd_band string")
    spec = S.TableSpec("t", tuple(c for c in S.STUDENT_INFO.columns if c.name == "imd_band"))
    assert column(clean.clean(df, spec), "imd_band") == [None, "10-20%", "0-10%", None]


@pytest.mark.parametrize("name", [n for n in S.TABLES if n != "student_vle"])
def test_cleaned_text_equals_typed_table(spark, folder, name):
    cleaned = clean.clean_tables(
        raw_tables(spark, folder), specs(), standins.SEGMENTS, [name]
    )[name]
    typed = standins.TYPED[name](spark, folder).select(*cleaned.columns)
    assert cleaned.count() == typed.count() > 0
    assert cleaned.exceptAll(typed).count() == 0


def test_cleaned_clicks_keep_every_row(spark, folder):
    cleaned = clean.clean_tables(
        raw_tables(spark, folder), specs(), standins.SEGMENTS, ["student_vle"]
    )["student_vle"]
    typed = standins.student_vle(spark, folder)
    assert cleaned.count() == typed.count()
    assert cleaned.where("sum_click IS NULL").count() > 0
    assert cleaned.where("sum_click IS NOT NULL").exceptAll(typed).count() == 0


def test_submissions_take_the_module_of_their_assessment(spark):
    raw = {
        "assessments": lambda: spark.createDataFrame(
            [("BBB", "2013J", "1", "TMA", "5", "10"), ("AAA", "2013J", "2", "TMA", "5", "10")],
            S.ASSESSMENTS.raw_schema,
        ),
        "student_assessment": lambda: spark.createDataFrame(
            [("1", "7", "-3", "0", "78.5"), ("2", "7", "4", "0", "50"), ("1", "8", "?", "?", "?")],
            S.STUDENT_ASSESSMENT.raw_schema,
        ),
    }
    table = clean.clean_tables(raw, S.TABLES, ["BBB"], ["student_assessment"])
    rows = tuples(table["student_assessment"].orderBy("id_student"))
    assert rows == [(1, 7, -3, 0, Decimal("78.50")), (1, 8, None, None, None)]


def test_recode_keeps_null_and_others(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert column(df.select(text.recoded(F.col("v"), {"a": "x"}).alias("v")), "v") == ["x", "b", None]
