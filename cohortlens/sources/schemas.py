"""The seven tables: raw (all text) and typed columns, accepted formats, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from cohortlens.functions.text import DECIMAL, SIGNED, UNSIGNED


@dataclass(frozen=True)
class ColumnSpec:
    """How one raw text column becomes a typed one.

    ``type`` is a Spark type or ``varchar(n)``. With ``pattern`` set, values of another format turn
    into NULL; without it the cast is hard. ``recode`` replaces listed values.
    """

    name: str
    type: str
    pattern: str | None = None
    recode: dict[str, str | None] = field(default_factory=dict)


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [column.name for column in self.columns]

    @property
    def raw_schema(self) -> T.StructType:
        return text_schema(self.names)


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``child`` rows point at ``parent`` rows through ``keys``."""

    name: str
    child: str
    parent: str
    keys: tuple[str, ...]


def text_schema(names: list[str]) -> T.StructType:
    """Every column as nullable text."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Tables, columns, types, keys and references of the data set.
MODULE = ColumnSpec("code_module", "varchar(10)")
PRESENTATION = ColumnSpec("code_presentation", "varchar(10)")
ENROLMENT = ("code_module", "code_presentation", "id_student")
COURSE = ("code_module", "code_presentation")

COURSES = TableSpec(
    "courses", (MODULE, PRESENTATION, ColumnSpec("module_presentation_length", "int")), COURSE
)
ASSESSMENTS = TableSpec(
    "assessments",
    (
        MODULE,
        PRESENTATION,
        ColumnSpec("id_assessment", "int"),
        ColumnSpec("assessment_type", "varchar(10)"),
        ColumnSpec("date", "int", UNSIGNED),
        ColumnSpec("weight", "decimal(5,2)", DECIMAL),
    ),
    ("id_assessment",),
)
VLE = TableSpec(
    "vle",
    (
        ColumnSpec("id_site", "int"),
        MODULE,
        PRESENTATION,
        ColumnSpec("activity_type", "varchar(30)"),
        ColumnSpec("week_from", "int", UNSIGNED),
        ColumnSpec("week_to", "int", UNSIGNED),
    ),
    ("id_site",),
)
STUDENT_INFO = TableSpec(
    "student_info",
    (
        MODULE,
        PRESENTATION,
        ColumnSpec("id_student", "int"),
        ColumnSpec("gender", "varchar(1)"),
        ColumnSpec("region", "varchar(50)"),
        ColumnSpec("highest_education", "varchar(50)"),
        ColumnSpec("imd_band", "varchar(10)", recode={"?": None, "10-20": "10-20%"}),
        ColumnSpec("age_band", "varchar(10)"),
        ColumnSpec("num_of_prev_attempts", "int", UNSIGNED),
        ColumnSpec("studied_credits", "int", UNSIGNED),
        ColumnSpec("disability", "varchar(1)"),
        ColumnSpec("final_result", "varchar(20)"),
    ),
    ENROLMENT,
)
STUDENT_REGISTRATION = TableSpec(
    "student_registration",
    (
        MODULE,
        PRESENTATION,
        ColumnSpec("id_student", "int"),
        ColumnSpec("date_registration", "int", SIGNED),
        ColumnSpec("date_unregistration", "int", SIGNED),
    ),
    ENROLMENT,
)
STUDENT_ASSESSMENT = TableSpec(
    "student_assessment",
    (
        ColumnSpec("id_assessment", "int"),
        ColumnSpec("id_student", "int"),
        ColumnSpec("date_submitted", "int", SIGNED),
        ColumnSpec("is_banked", "int", UNSIGNED),
        ColumnSpec("score", "decimal(5,2)", DECIMAL),
    ),
    ("id_assessment", "id_student"),
)
STUDENT_VLE = TableSpec(
    "student_vle",
    (
        MODULE,
        PRESENTATION,
        ColumnSpec("id_student", "int"),
        ColumnSpec("id_site", "int"),
        ColumnSpec("date", "int", SIGNED),
        ColumnSpec("sum_click", "int", UNSIGNED),
    ),
)
TABLES = {
    spec.name: spec
    for spec in (
        COURSES,
        ASSESSMENTS,
        VLE,
        STUDENT_INFO,
        STUDENT_REGISTRATION,
        STUDENT_ASSESSMENT,
        STUDENT_VLE,
    )
}

# CSV file of each table.
RAW_FILES = {
    "courses": "courses.csv",
    "assessments": "assessments.csv",
    "vle": "vle.csv",
    "student_info": "studentInfo.csv",
    "student_registration": "studentRegistration.csv",
    "student_assessment": "studentAssessment.csv",
    "student_vle": "studentVle.csv",
}

REFERENCES = (
    Reference("assessments_courses", "assessments", "courses", COURSE),
    Reference("vle_courses", "vle", "courses", COURSE),
    Reference("student_info_courses", "student_info", "courses", COURSE),
    Reference("student_registration_student_info", "student_registration", "student_info", ENROLMENT),
    Reference("student_assessment_assessments", "student_assessment", "assessments", ("id_assessment",)),
    Reference("student_vle_student_info", "student_vle", "student_info", ENROLMENT),
    Reference("student_vle_vle", "student_vle", "vle", ("id_site",)),
)

# Outcomes, ordered categories and activity types.
PASSED = ("Pass", "Distinction")
FAILED = "Fail"
WITHDRAWN = "Withdrawn"
EDUCATION_ORDER = (
    "No Formal quals",
    "Lower Than A Level",
    "A Level or Equivalent",
    "HE Qualification",
    "Post Graduate Qualification",
)
IMD_ORDER = (
    "0-10%",
    "10-20%",
    "20-30%",
    "30-40%",
    "40-50%",
    "50-60%",
    "60-70%",
    "70-80%",
    "80-90%",
    "90-100%",
)
MODEL_ACTIVITY_TYPES = ("forumng", "homepage", "oucontent", "quiz", "subpage", "resource")

# Schemas of the three exports that the models read.
ENROLMENT_FIELDS = [
    T.StructField("code_module", T.StringType()),
    T.StructField("code_presentation", T.StringType()),
    T.StructField("id_student", T.LongType()),
]
EARLY_EXPORT = T.StructType([*ENROLMENT_FIELDS, T.StructField("klicks_frueh", T.LongType())])
TYPE_EXPORT = T.StructType(
    [
        *ENROLMENT_FIELDS,
        T.StructField("activity_type", T.StringType()),
        T.StructField("klicks", T.LongType()),
    ]
)
REPORT_EXPORT = T.StructType(
    [
        T.StructField("id_student", T.LongType()),
        T.StructField("code_module", T.StringType()),
        T.StructField("code_presentation", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age_band", T.StringType()),
        T.StructField("imd_band", T.StringType()),
        T.StructField("highest_education", T.StringType()),
        T.StructField("disability", T.StringType()),
        T.StructField("final_result", T.StringType()),
        T.StructField("bestanden", T.IntegerType()),
        T.StructField("klicks_gesamt", T.LongType()),
        T.StructField("aktive_tage", T.LongType()),
        T.StructField("abgaben", T.LongType()),
        T.StructField("score_durchschnitt", T.DoubleType()),
        T.StructField("klicks_diff_vom_modulschnitt", T.DoubleType()),
    ]
)
