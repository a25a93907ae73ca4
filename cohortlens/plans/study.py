"""The whole study on the original seven tables: load, choose modules, audit, clean, report, model.

Ties the operators to the module codes, activity types and cleaning rules of the data set. Every
function takes the tables as a dict of DataFrames by name and works for any choice of modules.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import (
    audit,
    clean,
    features,
    integrity,
    logit,
    rates,
    report,
    scorecard,
    shares,
    usage,
)
from cohortlens.sources import csvfiles
from cohortlens.sources import schemas as S
from cohortlens.sources.tables import store

Tables = Mapping[str, DataFrame]

# The selected modules, the verdicts on all modules, outlier buckets and model types.
MODULES = ("BBB", "DDD", "FFF")
VERDICTS = {
    "AAA": "AUSGESCHLOSSEN: Stichprobe zu klein (712 Studierende) UND nur 2 Praesentationen",
    "CCC": "AUSGESCHLOSSEN: nur 2 Praesentationen (wie AAA) - weniger Zeitreihen-Potenzial",
    "EEE": "AUSGESCHLOSSEN: zu wenig disability-Faelle (168)",
    "GGG": "AUSGESCHLOSSEN: zu wenig disability-Faelle (356) und geringste Activity-Vielfalt",
    "BBB": "AUSGEWAEHLT",
    "DDD": "AUSGEWAEHLT",
    "FFF": "AUSGEWAEHLT",
}
CLICK_THRESHOLD = 100
CLICK_BUCKETS = (("100-500", 100, 500), ("501-1000", 501, 1000), ("1001-2000", 1001, 2000))
BEYOND = "ueber 2000"
MODEL_TYPES = ("oucontent", "forumng")
CATEGORIES = ("gender", "disability", "highest_education", "age_band", "imd_band")
BELOW_A_LEVEL = ("No Formal quals", "Lower Than A Level")
REPORT_TABLE = "mv_zentrumsbericht"


def getters(tables: Tables) -> dict[str, Callable[[], DataFrame]]:
    """The tables as functions, the form the cleaning operators take."""
    return {name: partial(tables.get, name) for name in tables}


def compare_modules(raw: Tables, modules: Sequence[str] = MODULES) -> DataFrame:
    """The scorecard of all modules, the selected ones first."""
    scores = raw["student_assessment"].join(
        raw["assessments"].select("id_assessment", "code_module"), "id_assessment"
    )
    spread = audit.numeric_profile(scores, "score", group="code_module").select(
        "code_module", F.col("streuung").alias("score_streuung")
    )
    variety = audit.distinct_profile(
        raw["vle"], "code_module", {"anzahl_activity_types": "activity_type"}
    )
    missing = F.col("imd_band") == "?"
    metrics = scorecard.group_metrics(raw["student_info"], "code_module", missing)
    return scorecard.group_scorecard(
        [metrics, spread, variety], "code_module", verdicts=VERDICTS, first=modules
    )


def audit_raw(raw: Tables, modules: Sequence[str] = MODULES) -> dict[str, DataFrame]:
    """The audit findings on the raw rows of the modules, by name."""

    def rows(name: str) -> DataFrame:
        return clean.in_modules(getters(raw), name, modules)

    info, clicks, scores = rows("student_info"), rows("student_vle"), rows("student_assessment")
    return {
        "score_format": audit.invalid_format_count(scores, "score"),
        "doppelte_abgaben": audit.duplicate_keys(scores, S.STUDENT_ASSESSMENT.key),
        "doppelte_einschreibungen": audit.duplicate_keys(info, S.ENROLMENT),
        "imd_fehlend": audit.missing_by_group(info, "imd_band", "code_module"),
        "klicks": audit.numeric_audit(clicks, "sum_click", CLICK_THRESHOLD),
        "klicks_bereiche": audit.outlier_buckets(
            clicks, "sum_click", CLICK_THRESHOLD, CLICK_BUCKETS, BEYOND
        ),
        "pruefung_ohne_datum": audit.missing_by_type(rows("assessments"), "date", "assessment_type"),
        "woche_platzhalter": audit.placeholder_counts(rows("vle"), "week_from", "activity_type"),
        "werte": audit.category_domains(info, CATEGORIES),
        "leerzeichen": audit.whitespace_domains(info, ("region", "highest_education")),
    }


def clean_and_store(
    raw: Tables, root: str, modules: Sequence[str] = MODULES
) -> dict[str, DataFrame]:
    """The typed tables of the modules under ``root``, the click table in a folder per module."""
    cleaned = clean.clean_tables(getters(raw), S.TABLES, modules)
    return store(cleaned, root, {"student_vle": "code_module"})


def check_cleaned(raw: Tables, cleaned: Tables, modules: Sequence[str] = MODULES) -> dict[str, DataFrame]:
    """Row counts against the raw tables, and violations of primary and foreign keys."""
    return {
        "zeilen": integrity.row_reconcile(
            [(n, clean.in_modules(getters(raw), n, modules), cleaned[n]) for n in S.TABLES]
        ),
        "primaerschluessel": integrity.pk_violations(cleaned, list(S.TABLES.values())),
        "fremdschluessel": integrity.fk_violations(cleaned, S.REFERENCES),
        "gewichte": integrity.weight_sum_check(cleaned["assessments"]),
        "abmeldungen": integrity.unregistration_check(
            cleaned["student_registration"], cleaned["student_info"], S.ENROLMENT
        ),
        "scores": integrity.score_domain_check(cleaned["student_assessment"]),
    }


def questions(cleaned: Tables, modules: Sequence[str] = MODULES) -> dict[str, Callable[[], DataFrame]]:
    """The analysis questions by their number, as functions."""
    info, clicks, sites = cleaned["student_info"], cleaned["student_vle"], cleaned["vle"]
    below = F.col("highest_education").isin(*BELOW_A_LEVEL)
    order = S.EDUCATION_ORDER
    return {
        "A1": lambda: shares.enrolments_vs_persons(info, "code_module", "id_student"),
        "A2": lambda: shares.share_within_group(info, "code_module", "final_result"),
        "A4": lambda: shares.share_within_group(info, "code_module", "imd_band"),
        "A4a": lambda: shares.side_by_side_share(info, "imd_band", modules, "fehlend"),
        "A4b": lambda: shares.side_by_side_share(info, "age_band", modules),
        "A4c": lambda: shares.side_by_side_share(info, "highest_education", modules, order=order),
        "A4d": lambda: shares.side_by_side_share(info, "region", modules, counts=False),
        "A4e": lambda: shares.conditional_share(info, "imd_band", below, "prozent_unter_a_level"),
        "A5": lambda: shares.flag_share(info, "code_module", "disability"),
        "B1": lambda: rates.outcome_rate(info, ["code_module"]),
        "B2": lambda: rates.outcome_rate(info, ["code_module", "disability"], withdrawal=True),
        "B3": lambda: rates.side_by_side_rate(info, "highest_education", modules, order=order),
        "B4": lambda: rates.side_by_side_rate(info, "imd_band", modules, "fehlend"),
        "B4_abbruch": lambda: rates.side_by_side_withdrawal(info, "imd_band", modules, "fehlend"),
        "C1a": lambda: usage.top_usage(clicks, sites, info),
        "C1b": lambda: usage.outcome_usage_ratio(
            usage.usage_per_entity(clicks, sites, since=0, types=S.MODEL_ACTIVITY_TYPES),
            info,
            S.MODEL_ACTIVITY_TYPES,
        ),
    }


def publish_report(cleaned: Tables, root: str, table: str = REPORT_TABLE) -> DataFrame:
    """Compute the report and store it as a table."""
    computed = report.enrolment_report(
        cleaned["student_info"],
        usage.clicks_from_start(cleaned["student_vle"]),
        usage.submissions(cleaned["student_assessment"], cleaned["assessments"]),
    )
    return report.materialise(computed, table, os.path.join(root, table))


def export_all(cleaned: Tables, published: DataFrame, root: str) -> dict[str, str]:
    """The report, the early clicks and the clicks per type as CSV folders; their paths."""
    by_type = usage.usage_per_entity(
        cleaned["student_vle"], cleaned["vle"], since=0, types=S.MODEL_ACTIVITY_TYPES
    )
    exports = {
        "zentrumsbericht": published,
        "klicks_frueh": usage.early_clicks(cleaned["student_vle"]),
        "klicks_typ": by_type,
    }
    return {
        name: csvfiles.export_csv(df, os.path.join(root, name)) for name, df in exports.items()
    }


def features_from_exports(
    spark: SparkSession, paths: Mapping[str, str], types: Sequence[str] = MODEL_TYPES
) -> DataFrame:
    """The model features from the three exported files."""
    lines = csvfiles.read_export(spark, paths["zentrumsbericht"], S.REPORT_EXPORT)
    early = csvfiles.read_export(spark, paths["klicks_frueh"], S.EARLY_EXPORT)
    by_type = csvfiles.read_export(spark, paths["klicks_typ"], S.TYPE_EXPORT)
    activity = (
        lines.select(*S.ENROLMENT, "klicks_gesamt")
        .join(early, list(S.ENROLMENT), "left")
        .join(usage.clicks_by_type_wide(by_type, types), list(S.ENROLMENT), "left")
    )
    return features.model_features(features.model_base(lines), activity, types)


def features_from_tables(cleaned: Tables, types: Sequence[str] = MODEL_TYPES) -> DataFrame:
    """The model features straight from the typed tables, in one pass over the clicks."""
    activity = usage.activity_profile(cleaned["student_vle"], cleaned["vle"], types)
    return features.model_features(features.model_base(cleaned["student_info"]), activity, types)


def fit_models(table: DataFrame, types: Sequence[str] = MODEL_TYPES) -> dict[str, logit.LogitFit]:
    """The four models by title; the reference module is the first in the data."""
    levels = tuple(sorted(set(features.EDUCATION_LEVELS.values())))
    factors = (
        features.Categorical("bildung", levels, features.EDUCATION_REFERENCE),
        features.categorical(table, "code_module"),
    )
    return logit.fit_models(table, logit.model_specs(types), factors)
