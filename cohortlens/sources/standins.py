"""The seven tables derived from the star-schema test tables.

The test data holds orders and line items, not students. These functions read them as if they were:
a customer in a year is an enrolment, a part is a learning page, a line item is a click event and a
supplier is an assessment. ``raw_*`` gives the same tables as text with placeholders put in.

Every join here is on a key whose one side is unique, and every grouping keeps fixed-width values
only, so Spark combines rows in hash tables before it shuffles them; a customer with a third of all
orders sends a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.functions.sized import small_side
from cohortlens.session import bound_tasks

# The mapping from the test tables to the domain.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SELECTED = SEGMENTS[:3]
EDUCATION = (
    "No Formal quals",
    "Lower Than A Level",
    "A Level or Equivalent",
    "HE Qualification",
    "Post Graduate Qualification",
)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NO_PRIORITY = "4-NOT SPECIFIED"
BANDS = tuple(p for p in PRIORITIES if p != NO_PRIORITY)
RESULTS = ("Distinction", "Fail", "Pass", "Withdrawn")
ASSESSMENT_TYPES = ("TMA", "CMA", "Exam")
ACTIVITY_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
EVENT_DAY = "CAST((l_orderkey * 7 + l_linenumber * 13) % 300 - 30 AS INT)"


@cache
def star_schema(application: str, path: str) -> T.StructType:
    """The schema in a file's footer, read once per application."""
    return SparkSession.active().read.parquet(path).schema


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_tasks(spark)
    path = os.path.join(folder, f"{name}.parquet")
    return spark.read.schema(star_schema(spark.sparkContext.applicationId, path)).parquet(path)


def pick(values: Sequence[str], index: str) -> str:
    """The value at a 0-based position, NULL for NULL."""
    cases = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {index} {cases} END"


def position(values: Sequence[str], text: str) -> str:
    """0-based position of a text as an int; a text that is not listed fails the job."""
    cases = " ".join(f"WHEN '{value}' THEN {i}" for i, value in enumerate(values))
    unlisted = f"CAST(raise_error(concat('not listed: ', {text})) AS INT)"
    return f"CASE {text} {cases} ELSE IF({text} IS NULL, NULL, {unlisted}) END"


def students(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with everything an enrolment takes from the person.

    The nations are counted and broadcast. Left to file sizes, Spark broadcasts the customers instead and
    goes through the few nations in a single task, which then makes all customers.
    """
    regions = star_table(spark, folder, "region").selectExpr(
        "r_regionkey AS n_regionkey", "r_name AS region"
    )
    places = (
        star_table(spark, folder, "nation")
        .join(regions, "n_regionkey")
        .selectExpr("n_nationkey AS c_nationkey", "region")
    )
    return (
        star_table(spark, folder, "customer")
        .join(small_side(places), "c_nationkey")
        .selectExpr(
            "c_mktsegment AS code_module",
            "c_custkey AS id_student",
            "IF(c_custkey % 2 = 0, 'M', 'F') AS gender",
            "region",
            f"{pick(EDUCATION, 'c_nationkey % 5')} AS highest_education",
            "CASE WHEN c_acctbal < 3000 THEN '0-35' WHEN c_acctbal < 7000 THEN '35-55' "
            "ELSE '55<=' END AS age_band",
            "IF(c_custkey % 10 = 0, 'Y', 'N') AS disability",
        )
    )


def student_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and order year.

    Both sides are shuffled by customer: Spark would otherwise broadcast the enrolments while they are few
    and make them in the tasks that read the customers, one or two of them for any number of enrolments.
    """
    priority = f"NULLIF(o_orderpriority, '{NO_PRIORITY}')"
    # Positions in RESULTS, which is in text order like PRIORITIES: the smallest position is the
    # smallest text.
    result = (
        "CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 3 "
        "WHEN o_totalprice > 200000 THEN 0 ELSE 2 END"
    )
    per_year = (
        star_table(spark, folder, "orders")
        .selectExpr(
            "o_custkey AS id_student",
            "year(o_orderdate) AS year",
            f"{position(PRIORITIES, priority)} AS band",
            f"{result} AS result",
        )
        .groupBy("id_student", "year")
        .agg({"band": "min", "result": "min"})
    )
    return per_year.join(students(spark, folder).hint("merge"), "id_student").selectExpr(
        "code_module",
        "CAST(year AS STRING) AS code_presentation",
        "id_student",
        "gender",
        "region",
        "highest_education",
        f"{pick(PRIORITIES, '`min(band)`')} AS imd_band",
        "age_band",
        "CAST(id_student % 3 AS INT) AS num_of_prev_attempts",
        "CAST(30 * (1 + id_student % 8) AS INT) AS studied_credits",
        "disability",
        f"{pick(RESULTS, '`min(result)`')} AS final_result",
    )


def courses(spark: SparkSession, folder: str) -> DataFrame:
    """Every module and presentation with an enrolment."""
    return (
        student_info(spark, folder)
        .select("code_module", "code_presentation")
        .distinct()
        .selectExpr(
            "*",
            "IF(CAST(code_presentation AS INT) % 2 = 0, 241, 268) AS module_presentation_length",
        )
    )


def student_registration(spark: SparkSession, folder: str) -> DataFrame:
    """One row per enrolment; a few unregistered without having withdrawn."""
    left = "(final_result = 'Withdrawn' OR id_student % 97 = 0) AND id_student % 89 <> 0"
    return student_info(spark, folder).selectExpr(
        "code_module",
        "code_presentation",
        "id_student",
        "CAST(IF(id_student % 71 <> 0, 10 - id_student % 190, NULL) AS INT) AS date_registration",
        f"CAST(IF({left}, id_student % 200 - 20, NULL) AS INT) AS date_unregistration",
    )


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    weight = "IF(s_suppkey % 3 = 2, 100, s_suppkey % 4 * 12.5)"
    return star_table(spark, folder, "supplier").selectExpr(
        f"{pick(SEGMENTS, 's_suppkey % 5')} AS code_module",
        "CAST(1995 + s_suppkey % 7 AS STRING) AS code_presentation",
        "s_suppkey AS id_assessment",
        f"{pick(ASSESSMENT_TYPES, 's_suppkey % 3')} AS assessment_type",
        "CAST(IF(s_suppkey % 3 <> 2, s_suppkey * 2, NULL) AS INT) AS date",
        f"CAST(IF(s_suppkey % 17 <> 0, {weight}, NULL) AS DECIMAL(5,2)) AS weight",
    )


def vle(spark: SparkSession, folder: str) -> DataFrame:
    return star_table(spark, folder, "part").selectExpr(
        "p_partkey AS id_site",
        f"{pick(SEGMENTS, 'p_partkey % 5')} AS code_module",
        "CAST(1995 + p_partkey % 7 AS STRING) AS code_presentation",
        "p_type AS activity_type",
        "IF(p_size % 3 = 0, p_size, NULL) AS week_from",
        "IF(p_size % 3 = 0, p_size + 1, NULL) AS week_to",
    )


def order_owners(spark: SparkSession, folder: str) -> DataFrame:
    """The enrolment of every order."""
    buyers = star_table(spark, folder, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_mktsegment AS code_module"
    )
    return (
        star_table(spark, folder, "orders")
        .join(buyers, "o_custkey")
        .selectExpr(
            "o_orderkey AS l_orderkey",
            "code_module",
            "CAST(year(o_orderdate) AS STRING) AS code_presentation",
            "o_custkey AS id_student",
        )
    )


def student_vle(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item.

    The customer joins the orders first, so line items are shuffled once, by order; the grouping
    that follows shuffles again anyway, which leaves Spark free to split a skewed order.
    """
    return (
        star_table(spark, folder, "lineitem")
        .join(order_owners(spark, folder), "l_orderkey")
        .selectExpr(
            "code_module",
            "code_presentation",
            "id_student",
            "l_partkey AS id_site",
            f"{EVENT_DAY} AS date",
            "CAST(l_quantity AS INT) AS sum_click",
        )
    )


def student_assessment(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and customer."""
    buyers = star_table(spark, folder, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "o_custkey AS id_student"
    )
    return (
        star_table(spark, folder, "lineitem")
        .join(buyers, "l_orderkey")
        .selectExpr(
            "l_suppkey AS id_assessment",
            "id_student",
            f"{EVENT_DAY} AS day",
            "l_linenumber % 2 AS banked",
            "CAST(IF(l_linenumber <> 7, l_quantity * 2, NULL) AS DECIMAL(5,2)) AS points",
        )
        .groupBy("id_assessment", "id_student")
        .agg({"day": "min", "banked": "min", "points": "min"})
        .selectExpr(
            "id_assessment",
            "id_student",
            "`min(day)` AS date_submitted",
            "`min(banked)` AS is_banked",
            "`min(points)` AS score",
        )
    )


TYPED = {
    "courses": courses,
    "assessments": assessments,
    "vle": vle,
    "student_info": student_info,
    "student_registration": student_registration,
    "student_assessment": student_assessment,
    "student_vle": student_vle,
}


#: Defects for the checks of references: per table, expressions that spoil keys of some rows. Years without
#: courses, ids nobody has, and missing ids.
DEFECTS = {
    "assessments": {"code_presentation": "IF(id_assessment % 13 = 0, '1899', code_presentation)"},
    "vle": {"code_presentation": "IF(id_site % 41 = 0, '1899', code_presentation)"},
    "student_info": {"code_presentation": "IF(id_student % 53 = 0, '1899', code_presentation)"},
    "student_registration": {"id_student": "IF(id_student % 47 = 0, -id_student, id_student)"},
    "student_assessment": {"id_assessment": "IF(id_student % 59 = 0, -id_assessment, id_assessment)"},
    "student_vle": {"id_site": "CASE WHEN id_site % 37 = 0 THEN -id_site WHEN id_site % 43 <> 0 THEN id_site END"},
}


def with_defects(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All rows of the typed tables, with the keys of some spoiled as ``DEFECTS`` says."""
    tables = {}
    for name, read in TYPED.items():
        df = read(spark, folder)
        spoiled = DEFECTS.get(name, {})
        tables[name] = df.selectExpr(*[f"{spoiled[c]} AS {c}" if c in spoiled else c for c in df.columns])
    return tables


def as_text(df: DataFrame, **replaced: str) -> DataFrame:
    """Every column as text, with the given expressions put in for some."""
    return df.selectExpr(
        *[f"{replaced.get(name, f'CAST({name} AS STRING)')} AS {name}" for name in df.columns]
    )


def or_marker(name: str, marker: str = "?") -> str:
    return f"COALESCE(CAST({name} AS STRING), '{marker}')"


def raw_courses(spark: SparkSession, folder: str) -> DataFrame:
    return as_text(courses(spark, folder))


def raw_assessments(spark: SparkSession, folder: str) -> DataFrame:
    """A missing exam date is NULL or ``?``, a missing weight ``?``."""
    date = f"IF(id_assessment % 2 = 0, CAST(date AS STRING), {or_marker('date')})"
    return as_text(assessments(spark, folder), date=date, weight=or_marker("weight"))


def raw_vle(spark: SparkSession, folder: str) -> DataFrame:
    """Missing weeks are ``?``, the empty text or NULL."""
    missing = "CASE id_site % 3 WHEN 0 THEN '?' WHEN 1 THEN '' END"
    week = f"COALESCE(CAST(week_from AS STRING), {missing})"
    return as_text(vle(spark, folder), week_from=week, week_to=or_marker("week_to", ""))


def raw_student_info(spark: SparkSession, folder: str) -> DataFrame:
    """Missing bands are ``?`` and one band is spelled differently."""
    band = f"IF(imd_band = '2-HIGH', 'HIGH', {or_marker('imd_band')})"
    return as_text(student_info(spark, folder), imd_band=band)


RAW_BAND_RECODE = {"?": None, "HIGH": "2-HIGH"}


def raw_student_registration(spark: SparkSession, folder: str) -> DataFrame:
    return as_text(
        student_registration(spark, folder),
        date_registration=or_marker("date_registration"),
        date_unregistration=or_marker("date_unregistration", ""),
    )


def raw_student_assessment(spark: SparkSession, folder: str) -> DataFrame:
    """Scores without decimals, but some written ``46.0``; missing ones are ``?``."""
    whole = "CAST(CAST(score AS INT) AS STRING)"
    score = f"COALESCE(IF(id_student % 25 = 0, concat({whole}, '.0'), {whole}), '?')"
    return as_text(student_assessment(spark, folder), score=score)


def raw_student_vle(spark: SparkSession, folder: str) -> DataFrame:
    """Click counts of some orders are ``?``, of some others the empty text."""
    clicks = (
        "CASE WHEN l_orderkey % 97 = 0 THEN '?' WHEN l_orderkey % 89 = 0 THEN '' "
        "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
    )
    return (
        star_table(spark, folder, "lineitem")
        .join(order_owners(spark, folder), "l_orderkey")
        .selectExpr(
            "code_module",
            "code_presentation",
            "CAST(id_student AS STRING) AS id_student",
            "CAST(l_partkey AS STRING) AS id_site",
            f"CAST({EVENT_DAY} AS STRING) AS date",
            f"{clicks} AS sum_click",
        )
    )


RAW = {
    "courses": raw_courses,
    "assessments": raw_assessments,
    "vle": raw_vle,
    "student_info": raw_student_info,
    "student_registration": raw_student_registration,
    "student_assessment": raw_student_assessment,
    "student_vle": raw_student_vle,
}
