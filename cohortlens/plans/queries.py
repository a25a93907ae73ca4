"""The registered queries: every operator on the tables derived from the test data.

Each takes (spark, folder) and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numeric import mean_of, rounded
from cohortlens.functions.ordering import ascending
from cohortlens.operators import (
    audit,
    changes,
    clean,
    consistency,
    features,
    identifiability,
    integrity,
    logit,
    rates,
    references,
    report,
    scorecard,
    shares,
    usage,
    versions,
)
from cohortlens.session import cut_lineage, scratch_path
from cohortlens.sources import csvfiles, standins
from cohortlens.sources import schemas as S
from cohortlens.sources.tables import create_view, read_tables, rebuild_database, write_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REBUILT = ("courses", "assessments", "vle", "student_info")
SELECTED = list(standins.SELECTED)
MODEL_TYPES = ("ECONOMY", "PROMO")
IMD_RANKS = {band: rank for rank, band in enumerate(standins.BANDS, 1)}
SCORECARD = (
    scorecard.Grading("gruppengroesse", "gruppengroesse", ((">=", 300, "+"),)),
    scorecard.Grading("anzahl_praesentationen", "praesentationen", ((">=", 7, "+"),), "o"),
    scorecard.Grading("score_streuung", "score_streuung", ((">=", 25, "+"), (">=", 20, "o"))),
    scorecard.Grading("anzahl_activity_types", "activity_vielfalt", ((">=", 6, "+"), (">=", 3, "o"))),
    scorecard.Grading("disability_faelle", "disability_faelle", ((">=", 160, "+"), (">=", 150, "o"))),
    scorecard.Grading("fehlende_imd_werte", "imd_vollstaendigkeit", (("<=", 150, "+"), ("<=", 165, "o"))),
    scorecard.Grading("anzahl_ergebnistypen", "ergebnistypen", (("==", 4, "+"),)),
)
VERDICTS = {module: "ausgewaehlt" for module in SELECTED} | {
    "HOUSEHOLD": "ausgeschlossen: zu klein",
    "MACHINERY": "ausgeschlossen: zu wenig Vielfalt",
}
CLICK_BUCKETS = (("20-30", 20, 30), ("31-40", 31, 40), ("41-45", 41, 45))
BIG_IDS = dict(id_student="bigint", id_site="bigint", id_assessment="bigint")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def info(spark: SparkSession, folder: str) -> DataFrame:
    return standins.student_info(spark, folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return standins.student_vle(spark, folder)


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return standins.vle(spark, folder)


# Audit


@query
def distinct_profile(spark, folder):
    return audit.distinct_profile(info(spark, folder), "code_module", {"anzahl_studierende": "id_student"})


@query
def distinct_profile_types(spark, folder):
    return audit.distinct_profile(
        sites(spark, folder), "code_module", {"anzahl_activity_types": "activity_type"}
    )


@query
def distinct_profile_presentations(spark, folder):
    return audit.distinct_profile(
        info(spark, folder), "code_module", {"anzahl_praesentationen": "code_presentation"}
    )


def scored(spark, folder):
    modules = standins.raw_assessments(spark, folder).select("id_assessment", "code_module")
    return standins.raw_student_assessment(spark, folder).join(modules, "id_assessment")


@query
def numeric_profile(spark, folder):
    return audit.numeric_profile(scored(spark, folder), "score", group="code_module")


@query
def numeric_profile_clicks(spark, folder):
    return audit.numeric_profile(standins.raw_student_vle(spark, folder), "sum_click")


@query
def duplicate_keys(spark, folder):
    return audit.duplicate_keys(
        standins.star_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query
def duplicate_keys_clicks(spark, folder):
    keys = ["code_module", "code_presentation", "id_student", "id_site", "date"]
    return audit.duplicate_keys(events(spark, folder), keys)


@query
def invalid_format_count(spark, folder):
    return audit.invalid_format_count(scored(spark, folder), "score")


@query
def missing_by_group(spark, folder):
    return audit.missing_by_group(standins.raw_student_info(spark, folder), "imd_band", "code_module")


@query
def missing_by_type(spark, folder):
    return audit.missing_by_type(standins.raw_assessments(spark, folder), "date", "assessment_type")


@query
def placeholder_counts(spark, folder):
    return audit.placeholder_counts(standins.raw_vle(spark, folder), "week_from", "activity_type")


@query
def outlier_count(spark, folder):
    return audit.outlier_count(standins.raw_student_vle(spark, folder), "sum_click", 20)


@query
def outlier_buckets(spark, folder):
    raw = standins.raw_student_vle(spark, folder)
    return audit.outlier_buckets(raw, "sum_click", 20, CLICK_BUCKETS, "ueber 45")


@query
def numeric_audit(spark, folder):
    return audit.numeric_audit(standins.raw_student_vle(spark, folder), "sum_click", 20)


@query
def category_domains(spark, folder):
    columns = ("gender", "disability", "highest_education", "age_band", "imd_band")
    return audit.category_domains(standins.raw_student_info(spark, folder), columns)


@query
def category_domain(spark, folder):
    return audit.category_domain(standins.raw_student_info(spark, folder), "imd_band")


def padded_info(spark, folder):
    padded = "IF(disability = 'Y', concat(region, ' '), region)"
    return standins.raw_student_info(spark, folder).withColumn("region", F.expr(padded))


@query
def whitespace_values(spark, folder):
    return audit.whitespace_values(padded_info(spark, folder), "region")


@query
def whitespace_domains(spark, folder):
    return audit.whitespace_domains(padded_info(spark, folder), ["region", "highest_education"])


@query
def group_counts(spark, folder):
    return audit.group_counts(info(spark, folder), "code_module", "final_result")


@query
def group_counts_disability(spark, folder):
    return audit.group_counts(info(spark, folder), "code_module", "disability")


@query
def group_counts_imd(spark, folder):
    return audit.group_counts(standins.raw_student_info(spark, folder), "code_module", "imd_band")


@query
def group_scorecard(spark, folder):
    enrolments = standins.raw_student_info(spark, folder)
    spread = audit.numeric_profile(scored(spark, folder), "score", group="code_module").select(
        "code_module", F.col("streuung").alias("score_streuung")
    )
    variety = audit.distinct_profile(
        standins.raw_vle(spark, folder), "code_module", {"anzahl_activity_types": "activity_type"}
    )
    metrics = scorecard.group_metrics(enrolments, "code_module", F.col("imd_band") == "?")
    return scorecard.group_scorecard(
        [metrics, spread, variety], "code_module", SCORECARD, VERDICTS, SELECTED
    )


# Cleaning and integrity


@cache
def specs() -> dict[str, S.TableSpec]:
    recode = {"imd_band": standins.RAW_BAND_RECODE}
    wider = dict(BIG_IDS, imd_band="varchar(15)", code_module="varchar(10)")
    return {name: clean.with_columns(spec, recode, **wider) for name, spec in S.TABLES.items()}


def raw_tables(spark, folder):
    return {name: partial(define, spark, folder) for name, define in standins.RAW.items()}


def typed_tables(spark, folder):
    return {name: define(spark, folder) for name, define in standins.TYPED.items()}


def clean_query(name: str) -> Query:
    def run(spark, folder):
        return clean.clean_tables(raw_tables(spark, folder), specs(), SELECTED, [name])[name]

    run.__name__ = f"clean_{name}"
    return run


for table in S.TABLES:
    query(clean_query(table))


@query
def row_reconcile(spark, folder):
    raw = raw_tables(spark, folder)
    stored = {name: cut_lineage(df) for name, df in clean.clean_tables(raw, specs(), SELECTED).items()}
    return integrity.row_reconcile(
        [(name, clean.in_modules(raw, name, SELECTED), stored[name]) for name in stored]
    )


@query
def orphans_assessment(spark, folder):
    tables = standins.with_defects(spark, folder)
    return integrity.orphans(tables["student_assessment"], tables["assessments"], ["id_assessment"])


@query
def orphans_site(spark, folder):
    tables = standins.with_defects(spark, folder)
    return integrity.orphans(tables["student_vle"], tables["vle"], ["id_site"])


@query
def fk_violations(spark, folder):
    """All references of the whole tables, some of whose keys are spoiled, in one pass."""
    return references.reference_violations(standins.with_defects(spark, folder), S.REFERENCES)


@query
def pk_violations(spark, folder):
    weeks = S.TableSpec("vle_weeks", S.VLE.columns, ("activity_type", "week_from"))
    tables = typed_tables(spark, folder)
    tables["vle_weeks"] = tables["vle"]
    return integrity.pk_violations(tables, [*(table for table in S.TABLES.values() if table.key), weeks])


@query
def weight_sum_check(spark, folder):
    return integrity.weight_sum_check(standins.assessments(spark, folder))


@query
def unregistration_check(spark, folder):
    return integrity.unregistration_check(
        standins.student_registration(spark, folder), info(spark, folder), S.ENROLMENT
    )


@query
def score_domain_check(spark, folder):
    return integrity.score_domain_check(standins.student_assessment(spark, folder), lowest=4, highest=96)


# Group sizes, shares and rates


@query
def enrolments_vs_persons(spark, folder):
    return shares.enrolments_vs_persons(info(spark, folder), "code_module", "id_student")


@query
def repeat_surplus(spark, folder):
    return shares.repeat_surplus(info(spark, folder), "code_module", "id_student")


@query
def repeat_enrolments(spark, folder):
    return shares.repeat_enrolments(info(spark, folder), "code_module", "id_student", n=10)


@query
def enrolment_lookup(spark, folder):
    return shares.enrolment_lookup(info(spark, folder), [3, 4, 5, 6, 7, 8, 9], "BUILDING")


@query
def share_within_group(spark, folder):
    return shares.share_within_group(info(spark, folder), "code_module", "final_result")


@query
def share_within_group_imd(spark, folder):
    return shares.share_within_group(info(spark, folder), "code_module", "imd_band")


@query
def side_by_side_share(spark, folder):
    return shares.side_by_side_share(info(spark, folder), "imd_band", SELECTED, null_label="fehlend")


@query
def side_by_side_share_age(spark, folder):
    return shares.side_by_side_share(info(spark, folder), "age_band", SELECTED)


@query
def side_by_side_share_education(spark, folder):
    return shares.side_by_side_share(
        info(spark, folder), "highest_education", SELECTED, order=S.EDUCATION_ORDER
    )


@query
def side_by_side_share_pct(spark, folder):
    return shares.side_by_side_share(info(spark, folder), "region", SELECTED, counts=False)


@query
def conditional_share(spark, folder):
    below = F.col("highest_education").isin("No Formal quals", "Lower Than A Level")
    return shares.conditional_share(info(spark, folder), "imd_band", below, "prozent_unter_a_level")


@query
def flag_share(spark, folder):
    return shares.flag_share(info(spark, folder), "code_module", "disability")


@query
def outcome_rate(spark, folder):
    return rates.outcome_rate(info(spark, folder), ["code_module"])


@query
def outcome_rate_by_flag(spark, folder):
    return rates.outcome_rate(info(spark, folder), ["code_module", "disability"], withdrawal=True)


@query
def rate_gap(spark, folder):
    return rates.rate_gap(info(spark, folder), "code_module", "disability")


@query
def side_by_side_rate(spark, folder):
    return rates.side_by_side_rate(
        info(spark, folder), "highest_education", SELECTED, order=S.EDUCATION_ORDER
    )


@query
def side_by_side_rate_imd(spark, folder):
    return rates.side_by_side_rate(info(spark, folder), "imd_band", SELECTED, null_label="fehlend")


@query
def side_by_side_withdrawal(spark, folder):
    return rates.side_by_side_withdrawal(info(spark, folder), "imd_band", SELECTED, null_label="fehlend")


@query
def band_gradient(spark, folder):
    return rates.band_gradient(info(spark, folder), "imd_band", standins.BANDS[0], standins.BANDS[-1])


# Usage and report


@query
def top_usage(spark, folder):
    return usage.top_usage(events(spark, folder), sites(spark, folder), info(spark, folder))


@query
def clicks_by_type(spark, folder):
    return usage.usage_per_entity(
        events(spark, folder), sites(spark, folder), since=0, types=standins.ACTIVITY_TYPES
    )


@query
def outcome_usage_ratio(spark, folder):
    return usage.outcome_usage_ratio(
        clicks_by_type(spark, folder), info(spark, folder), standins.ACTIVITY_TYPES
    )


@query
def clicks_from_start(spark, folder):
    return usage.clicks_from_start(events(spark, folder))


@query
def early_clicks(spark, folder):
    return usage.early_clicks(events(spark, folder))


@query
def submissions(spark, folder):
    return usage.submissions(
        standins.student_assessment(spark, folder), standins.assessments(spark, folder)
    )


def passed_per_assessment(spark, folder):
    return consistency.pass_counts(standins.student_assessment(spark, folder), standins.assessments(spark, folder))


@query
def pair_consistency(spark, folder):
    return consistency.pair_consistency(passed_per_assessment(spark, folder))


@query
def group_consistency(spark, folder):
    return consistency.group_consistency(passed_per_assessment(spark, folder))


@query
def enrolment_report(spark, folder):
    return report.enrolment_report(
        info(spark, folder), clicks_from_start(spark, folder), submissions(spark, folder)
    )


def view(spark, folder):
    return report.report_view(
        info(spark, folder), clicks_from_start(spark, folder), submissions(spark, folder)
    )


@query
def report_view(spark, folder):
    return create_view(spark, "bericht", partial(view, spark, folder))


@query
def report_counts(spark, folder):
    return report.report_counts(view(spark, folder))


def stored_report(spark, folder):
    target = scratch_path(spark, "report")
    table = f"bericht_{uuid.uuid4().hex}"  # runs at the same time do not share a table
    return released(report.materialise(enrolment_report(spark, folder), table, target), table)


def released(stored: DataFrame, table: str) -> DataFrame:
    """``stored``, still read from its files after its table has left the catalog."""
    stored.sparkSession.sql(f"DROP TABLE {table}")
    return stored


@query
def report_materialised(spark, folder):
    return report.mean_clicks(stored_report(spark, folder))


@query
def report_view_means(spark, folder):
    """The same means from the view, computed instead of read."""
    return report.mean_clicks(view(spark, folder))


@query
def report_stored_counts(spark, folder):
    return report.report_counts(stored_report(spark, folder))


@query
def report_refreshed(spark, folder):
    """A report stored without the withdrawn enrolments, after its refresh from the whole source."""
    current = enrolment_report(spark, folder)
    older = current.where(F.col("final_result") != S.WITHDRAWN)
    table, target = f"bericht_{uuid.uuid4().hex}", scratch_path(spark, "report")
    report.materialise(older, table, target)
    return report.mean_clicks(released(report.refresh(current, table, target), table))


@query
def rebuild_counts(spark, folder):
    """Rows of tables whose database was built twice: the second run replaces the first."""
    database, root = f"stand_{uuid.uuid4().hex}", scratch_path(spark, "database")
    typed = {name: standins.TYPED[name](spark, folder) for name in REBUILT}
    for _ in range(2):
        rebuild_database(spark, database, root)
        write_tables(typed, database)
    stored = read_tables(spark, database, list(REBUILT))
    counts = integrity.union_all(
        [df.agg(F.count("*").alias("zeilen")).select(F.lit(name).alias("tabelle"), "zeilen") for name, df in stored.items()]
    )
    counted = cut_lineage(counts)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return counted


@query
def report_key_duplicates(spark, folder):
    """Key check on the report and, to have repetitions, on the report per person."""
    stored = stored_report(spark, folder)
    checks = {"einschreibung": S.ENROLMENT, "person": ("code_module", "id_student")}
    return integrity.union_all(
        [
            audit.duplicate_keys(stored, keys)
            .agg(F.count("*").alias("doppelte"))
            .select(F.lit(name).alias("schluessel"), "doppelte")
            for name, keys in checks.items()
        ]
    )


#: How a stored copy of the report differs from it: ids, clicks, bands and means of some enrolments.
OLDER_REPORT = {
    "id_student": "IF(id_student % 83 = 0, -id_student, id_student)",
    "klicks_gesamt": "IF(id_student % 31 = 0, klicks_gesamt + 1, klicks_gesamt)",
    "imd_band": "IF(id_student % 29 = 0, coalesce(imd_band, 'unbekannt'), imd_band)",
    "score_durchschnitt": "IF(id_student % 37 <> 0, score_durchschnitt, NULL)",
}


def report_and_older_copy(spark, folder) -> tuple[DataFrame, DataFrame]:
    computed = cut_lineage(enrolment_report(spark, folder))
    older = computed.selectExpr(*[f"{OLDER_REPORT.get(c, c)} AS {c}" for c in computed.columns])
    return computed, spark.read.parquet(report.write_version(older, scratch_path(spark, "report"), S.ENROLMENT))


@query
def report_diff(spark, folder):
    """The computed report against a stored copy in which some rows are different."""
    return report.report_diff(*report_and_older_copy(spark, folder))


@query
def report_changes(spark, folder):
    """The same, by key: enrolments added, removed and changed since the copy, and which columns changed."""
    computed, older = report_and_older_copy(spark, folder)
    return changes.table_changes(older, computed, S.ENROLMENT)


#: The module whose clicks differ when the refresh by modules begins.
CHANGED_MODULE = "BUILDING"


def report_sources(spark, folder) -> dict[str, DataFrame]:
    """The sources, stored: a refresh reads each of them for its digests and again for what it builds."""
    sources = {"einschreibungen": info(spark, folder), "klicks": events(spark, folder), "abgaben": submissions(spark, folder)}
    return {name: cut_lineage(df) for name, df in sources.items()}


def report_from(sources) -> DataFrame:
    return report.enrolment_report(
        sources["einschreibungen"], usage.clicks_from_start(sources["klicks"]), sources["abgaben"]
    )


@query
def report_refreshed_modules(spark, folder):
    """A report stored per module, after one module's clicks changed and a refresh wrote that module anew."""
    sources = report_sources(spark, folder)
    older = sources["klicks"].withColumn(
        "sum_click", F.expr(f"IF(code_module = '{CHANGED_MODULE}' AND id_student % 2 = 0, sum_click + 1, sum_click)")
    )
    table, target = f"stand_{uuid.uuid4().hex}", scratch_path(spark, "report")
    refresh = partial(versions.refresh_changed, build=report_from, table=table, folder=target, group="code_module", keys=S.ENROLMENT)
    refresh(sources | {"klicks": older})
    listed = refresh(sources)
    # Only the columns of the report are asked for, so its build gets no rows.
    stored = versions.read_groups(listed, report_from({name: df.limit(0) for name, df in sources.items()}))
    written = cut_lineage(listed.select(F.col("gruppe").alias("code_module"), F.col("neu").cast("int").alias("neu_geschrieben")))
    spark.sql(f"DROP TABLE {table}")
    means = stored.groupBy("code_module").agg(
        F.count("*").alias("zeilen"), rounded(mean_of(F.col("klicks_gesamt")), 1).alias("klicks_schnitt")
    )
    return means.join(written, "code_module").orderBy(*ascending("code_module"))


@query
def csv_roundtrip(spark, folder):
    """Raw enrolments exported as CSV, loaded again as text, and counted."""
    raw = standins.raw_student_info(spark, folder)
    path = csvfiles.export_csv(raw, scratch_path(spark, "csv"))
    loaded = csvfiles.load_text_csv(spark, path, raw.columns)
    return audit.group_counts(loaded, "code_module", "imd_band", "final_result")


def exported(spark, df: DataFrame, schema) -> DataFrame:
    path = csvfiles.export_csv(df.select(*schema.names), scratch_path(spark, "csv"))
    return csvfiles.read_export(spark, path, schema)


@query
def export_report(spark, folder):
    return exported(spark, enrolment_report(spark, folder), S.REPORT_EXPORT)


@query
def export_early_clicks(spark, folder):
    return exported(spark, early_clicks(spark, folder), S.EARLY_EXPORT)


@query
def export_clicks_by_type(spark, folder):
    return exported(spark, clicks_by_type(spark, folder), S.TYPE_EXPORT)


# Features and models


def base_of(spark, folder):
    return features.model_base(info(spark, folder), IMD_RANKS)


def base_with(spark, folder, activity: DataFrame, column: str) -> DataFrame:
    return features.with_activity(base_of(spark, folder), activity, [column])


def clicks_of(spark, folder):
    return usage.usage_per_entity(events(spark, folder), since=0, name="klicks_gesamt")


@query
def model_base(spark, folder):
    base = base_with(spark, folder, clicks_of(spark, folder), "klicks_gesamt")
    return base.select(*S.ENROLMENT, *features.MODEL_COLUMNS, "klicks_gesamt")


@query
def model_base_size(spark, folder):
    return base_of(spark, folder).agg(F.count("*").alias("zeilen"))


def model_features(spark, folder):
    profile = usage.activity_profile(
        events(spark, folder), sites(spark, folder), standins.ACTIVITY_TYPES
    )
    return features.model_features(base_of(spark, folder), profile, standins.ACTIVITY_TYPES)


def digits(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name in names})


def standardised(spark, folder, activity: DataFrame, column: str, name: str) -> DataFrame:
    base = base_with(spark, folder, activity, column).select(*S.ENROLMENT, column)
    return digits(features.zscore_log1p(cut_lineage(base), {name: column}), name)


@query
def zscore_log1p(spark, folder):
    return standardised(spark, folder, clicks_of(spark, folder), "klicks_gesamt", "klicks_z")


@query
def features_early(spark, folder):
    return standardised(spark, folder, early_clicks(spark, folder), "klicks_frueh", "frueh_z")


@query
def clicks_by_type_wide(spark, folder):
    return usage.clicks_by_type_wide(clicks_by_type(spark, folder), standins.ACTIVITY_TYPES)


@query
def activity_profile(spark, folder):
    return usage.activity_profile(
        events(spark, folder), sites(spark, folder), standins.ACTIVITY_TYPES
    )


def factors():
    return (
        features.Categorical("bildung", ("A_Level", "Studium", "unter_A_Level"), "unter_A_Level"),
        features.Categorical("code_module", standins.SEGMENTS, standins.SEGMENTS[0]),
    )


@query
def design_matrix(spark, folder):
    design = logit.model_design(base_of(spark, folder), logit.model_specs()[0], factors())
    return design.groupBy(*[f"`{c}`" for c in design.columns]).agg(F.count("*").alias("zeilen"))


def model(name: str) -> logit.ModelSpec:
    return next(spec for spec in logit.model_specs(MODEL_TYPES) if spec.name == name)


def model_table(name: str, spark, folder) -> DataFrame:
    """Features of one model; the demographic one needs no clicks."""
    return base_of(spark, folder) if not model(name).activity else model_features(spark, folder)


def logit_query(name: str) -> Query:
    def run(spark, folder):
        """Sums of term times fitted probability, which at the optimum are those of term times outcome."""
        table = model_table(name, spark, folder)
        fit = logit.fit_model(table, model(name), factors())
        design = logit.model_design(table, model(name), factors())
        p = fit.probability()
        sums = design.agg(
            F.sum(p).alias("s0"),
            *[F.sum(F.col(f"`{t}`") * p).alias(f"s{i}") for i, t in enumerate(fit.terms[1:], 1)],
        )
        entries = [
            F.struct(F.lit(t).alias("term"), F.round(f"s{i}", 3).alias("summe"))
            for i, t in enumerate(fit.terms)
        ]
        return sums.select(F.inline(F.array(*entries)))

    run.__name__ = f"logit_{name}"
    return run


def odds_query(name: str) -> Query:
    def run(spark, folder):
        fit = logit.fit_model(model_table(name, spark, folder), model(name), factors())
        return logit.odds_ratios(spark, fit)

    run.__name__ = f"odds_ratio_{name}"
    return run


for spec in logit.model_specs(MODEL_TYPES):
    query(logit_query(spec.name))
    query(odds_query(spec.name))


def all_fits(spark, folder) -> dict[str, logit.LogitFit]:
    return logit.fit_models(model_features(spark, folder), logit.model_specs(MODEL_TYPES), factors())


@query
def pseudo_r2(spark, folder):
    rows = [(title, logit.pseudo_r2(fit, 6)) for title, fit in all_fits(spark, folder).items()]
    return spark.createDataFrame(rows, "modell string, pseudo_r2 double")


@query
def forest_table(spark, folder):
    return logit.forest_table(spark, all_fits(spark, folder))


@query
def effect_size_label(spark, folder):
    fit = logit.fit_model(base_of(spark, folder), model("m1"), factors())
    return logit.with_effect_size(logit.odds_ratios(spark, fit, digits=None)).select(
        "term", "effekt", "signifikanz"
    )


@query
def logit_single_flag(spark, folder):
    """One yes/no term, where odds ratio and interval have a closed form."""
    design = features.design_matrix(base_of(spark, folder), "bestanden", ["disability_ja"])
    fit = logit.logit_fit(design, "bestanden", discrete=True)
    return logit.odds_ratios(spark, fit).select("term", "OR", "ci_unten", "ci_oben")


def wide_features(spark, folder):
    wide = clicks_by_type_wide(spark, folder)
    base = base_of(spark, folder).select(*S.ENROLMENT)
    return features.with_activity(base, wide, standins.ACTIVITY_TYPES)


@query
def type_correlation(spark, folder):
    return identifiability.type_correlation(wide_features(spark, folder), standins.ACTIVITY_TYPES)


@query
def identifiability_report(spark, folder):
    return identifiability.identifiability_report(
        wide_features(spark, folder), standins.ACTIVITY_TYPES, "code_module", high=0.1
    )


@query
def design_rank(spark, folder):
    """All types and their sum in one design: the sum depends on the types."""
    total = " + ".join(standins.ACTIVITY_TYPES)
    wide = wide_features(spark, folder).selectExpr(*standins.ACTIVITY_TYPES, f"{total} AS summe")
    return identifiability.rank_report(wide, [*standins.ACTIVITY_TYPES, "summe"])


@query
def group_mean_z(spark, folder):
    return features.group_mean(model_features(spark, folder), "alter_35plus", "klicks_z", 4)
