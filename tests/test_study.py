"""The study end to end, on CSV files in the original layout."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import logit, report
from cohortlens.plans import study
from cohortlens.sources import csvfiles, standins
from cohortlens.sources import schemas as S
from conftest import tuples

MODULE_OF = dict(zip(standins.SEGMENTS, ("BBB", "DDD", "FFF", "AAA", "CCC")))
BAND_OF = {"1-URGENT": "0-10%", "HIGH": "10-20", "3-MEDIUM": "20-30%", "5-LOW": "90-100%", "?": "?"}
TYPE_OF = dict(zip(standins.ACTIVITY_TYPES, S.MODEL_ACTIVITY_TYPES))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("study"))


@pytest.fixture(scope="module")
def raw(spark, folder, root):
    """The raw stand-ins with the module codes, bands and types of the data set, via CSV."""
    for name, define in standins.RAW.items():
        df = define(spark, folder)
        for column, values in (("code_module", MODULE_OF), ("imd_band", BAND_OF), ("activity_type", TYPE_OF)):
            if column in df.columns:
                df = df.replace(values, subset=[column])
        csvfiles.export_csv(df.coalesce(1), os.path.join(root, "csv", S.RAW_FILES[name]))
    return csvfiles.load_raw_tables(spark, os.path.join(root, "csv"))


@pytest.fixture(scope="module")
def cleaned(raw, root):
    return study.clean_and_store(raw, os.path.join(root, "cleaned"))


def test_comparison_and_audit(raw):
    card = study.compare_modules(raw).collect()
    assert [r["code_module"] for r in card] == ["BBB", "DDD", "FFF", "AAA", "CCC"]
    assert card[0]["entscheidung"] == "AUSGEWAEHLT"
    found = {name: df.count() for name, df in study.audit_raw(raw).items()}
    assert found["imd_fehlend"] == 3 and found["doppelte_einschreibungen"] == 0
    assert found["werte"] == 2 + 2 + 5 + 3 + 5 and found["leerzeichen"] == 0


def test_cleaning_keeps_rows_and_keys(raw, cleaned, root):
    checks = study.check_cleaned(raw, cleaned)
    assert all(r["raw_zeilen"] == r["cleaned_zeilen"] > 0 for r in checks["zeilen"].collect())
    assert all(r["doppelte_schluessel"] == r["null_schluessel"] == 0 for r in checks["primaerschluessel"].collect())
    orphans = {r["beziehung"]: r["waisen"] for r in checks["fremdschluessel"].collect()}
    assert orphans["student_vle_student_info"] == orphans["student_registration_student_info"] == 0
    assert len(glob.glob(os.path.join(root, "cleaned", "student_vle", "code_module=*"))) == 3
    assert set(tuples(cleaned["student_info"].select("imd_band").distinct())) == {
        ("0-10%",), ("10-20%",), ("20-30%",), ("90-100%",), (None,),
    }


def test_every_question_has_an_answer(cleaned):
    for name, ask in study.questions(cleaned).items():
        assert ask().count() > 0, name


def test_report_exports_and_models(spark, cleaned, root):
    published = study.publish_report(cleaned, os.path.join(root, "analytics"))
    assert published.count() == cleaned["student_info"].count()
    paths = study.export_all(cleaned, published, os.path.join(root, "exports"))
    back = csvfiles.read_export(spark, paths["zentrumsbericht"], S.REPORT_EXPORT)
    same = published.withColumn("id_student", F.col("id_student").cast("bigint"))
    assert tuples(report.report_diff(same.select(*back.columns), back)) == [(0, 0, 0, 0)]

    from_files = study.features_from_exports(spark, paths)
    direct = study.features_from_tables(cleaned)
    rounded = [
        df.select(*S.ENROLMENT, *[F.round(z, 9).alias(z) for z in ("klicks_z", "frueh_z", "forumng_z")])
        .withColumn("id_student", F.col("id_student").cast("bigint"))
        for df in (from_files, direct)
    ]
    assert rounded[0].count() > 0 and rounded[0].exceptAll(rounded[1]).count() == 0
    fits = study.fit_models(direct)
    table = logit.forest_table(spark, fits)
    assert {r["modell"] for r in table.collect()} == set(fits)
    assert "Modul: DDD (Ref: BBB)" in {r["bezeichnung"] for r in table.collect()}
    spark.sql(f"DROP TABLE {study.REPORT_TABLE}")
