"""SQL twins of the registered queries, for DuckDB on the same tables.

Written from the definitions of the tables and results, not from the Spark code. Percentages and
means are rounded half up in integer arithmetic.
"""

from __future__ import annotations

import re

from cohortlens.plans.newton import newton_tables, two_sided_p

ORACLES: dict[str, str] = {}

KEYS = "code_module, code_presentation, id_student"
SELECTED = "('AUTOMOBILE','BUILDING','FURNITURE')"
PASSED = "final_result IN ('Pass','Distinction')"
FINISHED = "final_result <> 'Withdrawn'"
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEGMENT_OF = "CASE {0} % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END"
DAY = "((l_orderkey * 7 + l_linenumber * 13) % 300 - 30)::INT"

# Derived tables; a query takes the ones it names, in this order.
TABLES = {
    "people": """
        SELECT c_mktsegment AS code_module, c_custkey AS id_student,
               CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, r_name AS region,
               CASE c_nationkey % 5 WHEN 0 THEN 'No Formal quals' WHEN 1 THEN 'Lower Than A Level'
                    WHEN 2 THEN 'A Level or Equivalent' WHEN 3 THEN 'HE Qualification'
                    ELSE 'Post Graduate Qualification' END AS highest_education,
               CASE WHEN c_acctbal < 3000 THEN '0-35' WHEN c_acctbal < 7000 THEN '35-55'
                    ELSE '55<=' END AS age_band,
               CASE WHEN c_custkey % 10 = 0 THEN 'Y' ELSE 'N' END AS disability
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "info": """
        SELECT p.code_module, year(o_orderdate)::VARCHAR AS code_presentation, p.id_student,
               min(p.gender) AS gender, min(p.region) AS region,
               min(p.highest_education) AS highest_education,
               min(nullif(o_orderpriority, '4-NOT SPECIFIED')) AS imd_band,
               min(p.age_band) AS age_band,
               min(p.id_student % 3)::INT AS num_of_prev_attempts,
               min(30 * (1 + p.id_student % 8))::INT AS studied_credits,
               min(p.disability) AS disability,
               min(CASE WHEN o_orderstatus = 'F' THEN 'Fail' WHEN o_orderstatus = 'P' THEN 'Withdrawn'
                        WHEN o_totalprice > 200000 THEN 'Distinction' ELSE 'Pass' END) AS final_result
        FROM orders JOIN people p ON o_custkey = p.id_student GROUP BY 1, 2, 3""",
    "clicks": f"""
        SELECT c_mktsegment AS code_module, year(o_orderdate)::VARCHAR AS code_presentation,
               o_custkey AS id_student, l_partkey AS id_site, {DAY} AS date,
               l_quantity::INT AS sum_click,
               CASE WHEN l_orderkey % 97 = 0 THEN '?' WHEN l_orderkey % 89 = 0 THEN ''
                    ELSE (l_quantity::INT)::VARCHAR END AS raw_click
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey""",
    "sites": f"""
        SELECT p_partkey AS id_site, {SEGMENT_OF.format('p_partkey')} AS code_module,
               (1995 + p_partkey % 7)::VARCHAR AS code_presentation, p_type AS activity_type,
               CASE WHEN p_size % 3 = 0 THEN p_size END AS week_from,
               CASE WHEN p_size % 3 = 0 THEN p_size + 1 END AS week_to
        FROM part""",
    "exams": f"""
        SELECT {SEGMENT_OF.format('s_suppkey')} AS code_module,
               (1995 + s_suppkey % 7)::VARCHAR AS code_presentation, s_suppkey AS id_assessment,
               CASE s_suppkey % 3 WHEN 0 THEN 'TMA' WHEN 1 THEN 'CMA' ELSE 'Exam' END AS assessment_type,
               CASE WHEN s_suppkey % 3 <> 2 THEN (s_suppkey * 2)::INT END AS date,
               CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 3 = 2 THEN 100
                    ELSE s_suppkey % 4 * 12.5 END::DECIMAL(5,2) AS weight
        FROM supplier""",
    "submitted": f"""
        SELECT l_suppkey AS id_assessment, o_custkey AS id_student, min({DAY}) AS date_submitted,
               min(l_linenumber % 2)::INT AS is_banked,
               min(CASE WHEN l_linenumber <> 7 THEN (l_quantity * 2)::DECIMAL(5,2) END) AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "courses": """
        SELECT code_module, code_presentation,
               CASE WHEN code_presentation::INT % 2 = 0 THEN 241 ELSE 268 END AS module_presentation_length
        FROM info GROUP BY 1, 2""",
    "registered": f"""
        SELECT {KEYS}, CASE WHEN id_student % 71 <> 0 THEN (10 - id_student % 190)::INT END AS date_registration,
               CASE WHEN (final_result = 'Withdrawn' OR id_student % 97 = 0) AND id_student % 89 <> 0
                    THEN (id_student % 200 - 20)::INT END AS date_unregistration
        FROM info""",
    "raw_scores": """
        SELECT id_assessment, id_student, date_submitted, is_banked,
               CASE WHEN score IS NULL THEN '?' WHEN id_student % 25 = 0 THEN score::INT::VARCHAR || '.0'
                    ELSE score::INT::VARCHAR END AS score FROM submitted""",
    "scored": """
        SELECT s.score, e.code_module FROM raw_scores s JOIN exams e USING (id_assessment)""",
    "usage_all": f"""
        SELECT c.code_module, c.code_presentation, c.id_student, activity_type, sum(sum_click)::BIGINT AS klicks
        FROM clicks c JOIN sites s ON c.id_site = s.id_site GROUP BY 1, 2, 3, 4""",
    "by_type": f"""
        SELECT c.code_module, c.code_presentation, c.id_student, activity_type, sum(sum_click)::BIGINT AS klicks
        FROM clicks c JOIN sites s ON c.id_site = s.id_site WHERE date >= 0 GROUP BY 1, 2, 3, 4""",
    "from_start": f"""
        SELECT {KEYS}, sum(sum_click)::BIGINT AS klicks_gesamt, count(DISTINCT date) AS aktive_tage
        FROM clicks WHERE date >= 0 GROUP BY {KEYS}""",
    "early": f"""
        SELECT {KEYS}, sum(sum_click)::BIGINT AS klicks_frueh
        FROM clicks WHERE date BETWEEN 0 AND 27 GROUP BY {KEYS}""",
    "exam_results": """
        SELECT e.code_module, e.code_presentation, s.id_student, count(*) AS abgaben,
               ((sum(score) * 100)::HUGEINT + 5 * count(score)) // nullif(10 * count(score), 0) / 10.0
                   AS score_durchschnitt
        FROM submitted s JOIN exams e USING (id_assessment) GROUP BY 1, 2, 3""",
    "base": f"""
        SELECT i.id_student, i.code_module, i.code_presentation, gender, age_band, imd_band,
               highest_education, disability, final_result,
               CASE WHEN {PASSED} THEN 1 ELSE 0 END AS bestanden,
               coalesce(klicks_gesamt, 0) AS klicks_gesamt, coalesce(aktive_tage, 0) AS aktive_tage,
               coalesce(abgaben, 0) AS abgaben, score_durchschnitt::DOUBLE AS score_durchschnitt
        FROM info i LEFT JOIN from_start f USING ({KEYS}) LEFT JOIN exam_results r USING ({KEYS})""",
    "module_totals": """
        SELECT code_module, sum(klicks_gesamt)::HUGEINT AS s, count(*) AS n FROM base GROUP BY 1""",
    "report": """
        SELECT b.*, sign(klicks_gesamt * n - s)
               * ((20 * abs(klicks_gesamt * n - s) + n) // (2 * n))::DOUBLE / 10
                   AS klicks_diff_vom_modulschnitt
        FROM base b JOIN module_totals USING (code_module)""",
    "wide": "SELECT " + KEYS + ", " + ", ".join(
        f"coalesce(sum(klicks) FILTER (activity_type = '{t}'), 0)::DOUBLE AS {t}" for t in TYPES
    ) + f" FROM by_type GROUP BY {KEYS}",
    "modelled": f"""
        SELECT {KEYS}, bestanden, klicks_gesamt,
               CASE imd_band WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
                    WHEN '5-LOW' THEN 4 END AS imd,
               CASE WHEN highest_education IN ('No Formal quals','Lower Than A Level') THEN 'unter_A_Level'
                    WHEN highest_education = 'A Level or Equivalent' THEN 'A_Level'
                    ELSE 'Studium' END AS bildung,
               CASE WHEN age_band IS DISTINCT FROM '0-35' THEN 1 ELSE 0 END AS alter_35plus,
               CASE WHEN disability = 'Y' THEN 1 ELSE 0 END AS disability_ja,
               CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS weiblich
        FROM base WHERE {FINISHED} AND imd_band IS NOT NULL""",
    "active": f"""
        SELECT m.*, coalesce(klicks_frueh, 0) AS klicks_frueh,
               {", ".join(f"coalesce({t}, 0) AS {t}" for t in TYPES)}
        FROM modelled m LEFT JOIN early USING ({KEYS}) LEFT JOIN wide USING ({KEYS})""",
    "featured": "SELECT *, " + ", ".join(
        f"(ln(1 + {c}) - avg(ln(1 + {c})) OVER w) / nullif(stddev_samp(ln(1 + {c})) OVER w, 0) AS {name}"
        for name, c in (
            ("klicks_z", "klicks_gesamt"),
            ("frueh_z", "klicks_frueh"),
            ("ECONOMY_z", "ECONOMY"),
            ("PROMO_z", "PROMO"),
        )
    ) + " FROM active WINDOW w AS (PARTITION BY code_module)",
    "paired": f"""
        SELECT code_module, {", ".join(f"coalesce({t}, 0) AS {t}" for t in TYPES)}
        FROM modelled LEFT JOIN wide USING ({KEYS})""",
}


def sql(body: str, **more: str) -> str:
    """``body`` with the derived tables it needs put in front; ``more`` adds tables of its own."""
    needed: set[str] = set()
    pending = [body, *more.values()]
    while pending:
        text = pending.pop()
        for name in set(re.findall(r"\b[a-z_]+\b", text)) & set(TABLES) - needed:
            needed.add(name)
            pending.append(TABLES[name])
    parts = [f"{name} AS ({TABLES[name]})" for name in TABLES if name in needed]
    for name, text in more.items():
        stored = text.startswith("MATERIALIZED ")
        text = text.removeprefix("MATERIALIZED ")
        parts.append(f"{name} AS {'MATERIALIZED ' if stored else ''}({text})")
    return f"WITH {', '.join(parts)} {body}" if parts else body


def add(name: str, body: str, **more: str) -> None:
    ORACLES[name] = sql(body, **more)


def pct(part: str, whole: str) -> str:
    return f"((2000 * ({part})::HUGEINT + ({whole})) // nullif(2 * ({whole}), 0))::DOUBLE / 10"


def mean(total: str, n: str) -> str:
    """Non-negative total / n to one decimal."""
    return f"((20 * ({total})::HUGEINT + ({n})) // nullif(2 * ({n}), 0))::DOUBLE / 10"


def n_if(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


# Audit

add("distinct_profile", "SELECT code_module, count(DISTINCT id_student) AS anzahl_studierende FROM info GROUP BY 1")
add(
    "distinct_profile_types",
    "SELECT code_module, count(DISTINCT activity_type) AS anzahl_activity_types FROM sites GROUP BY 1",
)
add(
    "distinct_profile_presentations",
    "SELECT code_module, count(DISTINCT code_presentation) AS anzahl_praesentationen FROM info GROUP BY 1",
)
NUMBERS = """min(v)::DOUBLE AS minimum, max(v)::DOUBLE AS maximum,
    {mean} AS durchschnitt, round(stddev_samp(v), 1) AS streuung""".format(mean=mean("sum(v)", "count(v)"))
SCORE_NUMBERS = "SELECT code_module, score::INT AS v FROM scored WHERE regexp_full_match(score, '[0-9]+')"
CLICK_NUMBERS = "SELECT raw_click::INT AS v FROM clicks WHERE regexp_full_match(raw_click, '[0-9]+')"
add("numeric_profile", f"SELECT code_module, {NUMBERS} FROM numbers GROUP BY 1", numbers=SCORE_NUMBERS)
add("numeric_profile_clicks", f"SELECT {NUMBERS} FROM numbers", numbers=CLICK_NUMBERS)
add(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS anzahl FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
add(
    "duplicate_keys_clicks",
    f"SELECT {KEYS}, id_site, date, count(*) AS anzahl FROM clicks GROUP BY ALL HAVING count(*) > 1",
)
add(
    "invalid_format_count",
    "SELECT count(*) AS anzahl FROM scored WHERE NOT regexp_full_match(score, '[0-9]+')",
)
add(
    "missing_by_group",
    "SELECT code_module, count(*) AS anzahl FROM info WHERE imd_band IS NULL GROUP BY 1",
)
add(
    "missing_by_type",
    "SELECT assessment_type, count(*) AS anzahl FROM exams WHERE date IS NULL GROUP BY 1",
)
add(
    "placeholder_counts",
    f"""SELECT activity_type, count(*) AS anzahl,
        {n_if("week_from IS NULL AND id_site % 3 < 2")} AS platzhalter FROM sites GROUP BY 1""",
)
add("outlier_count", "SELECT count(*) AS anzahl FROM numbers WHERE v > 20", numbers=CLICK_NUMBERS)
add(
    "outlier_buckets",
    """SELECT CASE WHEN v BETWEEN 20 AND 30 THEN '20-30' WHEN v BETWEEN 31 AND 40 THEN '31-40'
            WHEN v BETWEEN 41 AND 45 THEN '41-45' ELSE 'ueber 45' END AS bereich, count(*) AS anzahl
       FROM numbers WHERE v > 20 GROUP BY 1""",
    numbers=CLICK_NUMBERS,
)
RAW_BAND = "CASE WHEN imd_band IS NULL THEN '?' WHEN imd_band = '2-HIGH' THEN 'HIGH' ELSE imd_band END"
add("category_domain", f"SELECT DISTINCT {RAW_BAND} AS imd_band FROM info")
add(
    "numeric_audit",
    f"""SELECT (SELECT count(*) FROM clicks) AS zeilen,
        (SELECT count(*) FROM clicks WHERE raw_click IN ('', '?')) AS ungueltig, {NUMBERS},
        {n_if("v > 20")} AS ausreisser FROM numbers""",
    numbers=CLICK_NUMBERS,
)
add(
    "category_domains",
    " UNION ".join(
        f"SELECT '{name}' AS spalte, {value} AS wert FROM info"
        for name, value in (
            ("gender", "gender"),
            ("disability", "disability"),
            ("highest_education", "highest_education"),
            ("age_band", "age_band"),
            ("imd_band", RAW_BAND),
        )
    ),
)
add(
    "whitespace_domains",
    "SELECT DISTINCT 'region' AS spalte, region || ' ' AS wert FROM info WHERE disability = 'Y'",
)
add("whitespace_values", "SELECT DISTINCT region || ' ' AS region FROM info WHERE disability = 'Y'")
for suffix, column in (("", "final_result"), ("_disability", "disability")):
    add(
        f"group_counts{suffix}",
        f"SELECT code_module, {column}, count(*) AS anzahl FROM info GROUP BY 1, 2",
    )
add(
    "group_counts_imd",
    f"SELECT code_module, {RAW_BAND} AS imd_band, count(*) AS anzahl FROM info GROUP BY 1, 2",
)
add(
    "group_scorecard",
    f"""SELECT code_module, CASE WHEN persons >= 300 THEN '+' ELSE '-' END AS gruppengroesse,
        CASE WHEN presentations >= 7 THEN '+' ELSE 'o' END AS praesentationen,
        CASE WHEN spread >= 25 THEN '+' WHEN spread >= 20 THEN 'o' ELSE '-' END AS score_streuung,
        CASE WHEN kinds >= 6 THEN '+' WHEN kinds >= 3 THEN 'o' ELSE '-' END AS activity_vielfalt,
        CASE WHEN flagged >= 160 THEN '+' WHEN flagged >= 150 THEN 'o' ELSE '-' END AS disability_faelle,
        CASE WHEN missing <= 150 THEN '+' WHEN missing <= 165 THEN 'o' ELSE '-' END AS imd_vollstaendigkeit,
        CASE WHEN results = 4 THEN '+' ELSE '-' END AS ergebnistypen,
        CASE WHEN code_module IN {SELECTED} THEN 'ausgewaehlt'
             WHEN code_module = 'HOUSEHOLD' THEN 'ausgeschlossen: zu klein'
             WHEN code_module = 'MACHINERY' THEN 'ausgeschlossen: zu wenig Vielfalt' ELSE '' END AS entscheidung
        FROM figures JOIN spreads USING (code_module) JOIN variety USING (code_module)""",
    figures=f"""SELECT code_module, count(DISTINCT id_student) AS persons,
        count(DISTINCT code_presentation) AS presentations, {n_if("disability = 'Y'")} AS flagged,
        {n_if("imd_band IS NULL")} AS missing, count(DISTINCT final_result) AS results
        FROM info GROUP BY 1""",
    spreads=f"SELECT code_module, round(stddev_samp(v), 1) AS spread FROM ({SCORE_NUMBERS}) GROUP BY 1",
    variety="SELECT code_module, count(DISTINCT activity_type) AS kinds FROM sites GROUP BY 1",
)

# Cleaning and integrity

add(
    "clean_courses",
    f"""SELECT code_module, code_presentation, module_presentation_length::INT AS module_presentation_length
        FROM courses WHERE code_module IN {SELECTED}""",
)
add("clean_assessments", f"SELECT * FROM exams WHERE code_module IN {SELECTED}")
add("clean_vle", f"SELECT * FROM sites WHERE code_module IN {SELECTED}")
add("clean_student_info", f"SELECT * FROM info WHERE code_module IN {SELECTED}")
add("clean_student_registration", f"SELECT * FROM registered WHERE code_module IN {SELECTED}")
add(
    "clean_student_assessment",
    f"""SELECT id_assessment, id_student, date_submitted, is_banked,
        CASE WHEN regexp_full_match(score, '[0-9]+\\.?[0-9]*') THEN score::DECIMAL(5,2) END AS score
        FROM raw_scores WHERE id_assessment IN (SELECT id_assessment FROM exams WHERE code_module IN {SELECTED})""",
)
add(
    "clean_student_vle",
    f"""SELECT {KEYS}, id_site, date,
        CASE WHEN regexp_full_match(raw_click, '[0-9]+') THEN raw_click::INT END AS sum_click
        FROM clicks WHERE code_module IN {SELECTED}""",
)
TYPED = {
    "courses": "courses",
    "assessments": "exams",
    "vle": "sites",
    "student_info": "info",
    "student_registration": "registered",
    "student_vle": "clicks",
}
RAW_ROWS = {
    name: f"SELECT count(*) FROM {table} WHERE code_module IN {SELECTED}" for name, table in TYPED.items()
} | {
    "student_assessment": f"""SELECT count(*) FROM submitted JOIN exams USING (id_assessment)
        WHERE code_module IN {SELECTED}"""
}
# The cleaned side is counted from the twins of the cleaned tables.
add(
    "row_reconcile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS tabelle, ({raw}) AS raw_zeilen,
        (SELECT count(*) FROM ({ORACLES[f"clean_{name}"]})) AS cleaned_zeilen"""
        for name, raw in RAW_ROWS.items()
    ),
)
SPOILED = {
    "courses": "SELECT * FROM courses",
    "assessments": """SELECT * REPLACE (CASE WHEN id_assessment % 13 = 0 THEN '1899' ELSE code_presentation END
        AS code_presentation) FROM exams""",
    "vle": """SELECT * REPLACE (CASE WHEN id_site % 41 = 0 THEN '1899' ELSE code_presentation END
        AS code_presentation) FROM sites""",
    "student_info": """SELECT * REPLACE (CASE WHEN id_student % 53 = 0 THEN '1899' ELSE code_presentation END
        AS code_presentation) FROM info""",
    "student_registration": """SELECT * REPLACE (CASE WHEN id_student % 47 = 0 THEN -id_student ELSE id_student END
        AS id_student) FROM registered""",
    "student_assessment": """SELECT * REPLACE (CASE WHEN id_student % 59 = 0 THEN -id_assessment
        ELSE id_assessment END AS id_assessment) FROM submitted""",
    "student_vle": """SELECT * REPLACE (CASE WHEN id_site % 37 = 0 THEN -id_site WHEN id_site % 43 <> 0 THEN id_site
        END AS id_site) FROM clicks""",
}
COURSE = ("code_module", "code_presentation")
EDGES = (
    ("assessments", "courses", COURSE),
    ("vle", "courses", COURSE),
    ("student_info", "courses", COURSE),
    ("student_registration", "student_info", (*COURSE, "id_student")),
    ("student_assessment", "assessments", ("id_assessment",)),
    ("student_vle", "student_info", (*COURSE, "id_student")),
    ("student_vle", "vle", ("id_site",)),
)


def orphans_of(child: str, parent: str, keys: tuple[str, ...]) -> str:
    """Child rows whose key is complete and that no parent has."""
    return f"""FROM ({SPOILED[child]}) c WHERE {" AND ".join(f"c.{k} IS NOT NULL" for k in keys)}
        AND NOT EXISTS (SELECT 1 FROM ({SPOILED[parent]}) p WHERE {" AND ".join(f"p.{k} = c.{k}" for k in keys)})"""


add("orphans_assessment", f"SELECT count(*) AS waisen {orphans_of('student_assessment', 'assessments', ('id_assessment',))}")
add("orphans_site", f"SELECT count(*) AS waisen {orphans_of('student_vle', 'vle', ('id_site',))}")
add(
    "fk_violations",
    " UNION ALL ".join(
        f"""SELECT '{child}_{parent}' AS beziehung, '{child}' AS kind, '{parent}' AS eltern, count(*) AS waisen,
        count(DISTINCT ({", ".join(f"c.{k}" for k in keys)})) AS schluessel {orphans_of(child, parent, keys)}"""
        for child, parent, keys in EDGES
    ),
)
PRIMARY = {
    "courses": ("courses", COURSE),
    "assessments": ("exams", ("id_assessment",)),
    "vle": ("sites", ("id_site",)),
    "student_info": ("info", (*COURSE, "id_student")),
    "student_registration": ("registered", (*COURSE, "id_student")),
    "student_assessment": ("submitted", ("id_assessment", "id_student")),
    "vle_weeks": ("sites", ("activity_type", "week_from")),
}
add(
    "pk_violations",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS tabelle,
        count(*) FILTER (n > 1 AND {" AND ".join(f"{k} IS NOT NULL" for k in keys)}) AS doppelte_schluessel,
        coalesce(sum(n) FILTER ({" OR ".join(f"{k} IS NULL" for k in keys)}), 0)::BIGINT AS null_schluessel
        FROM (SELECT {", ".join(keys)}, count(*) AS n FROM {table} GROUP BY ALL)"""
        for name, (table, keys) in PRIMARY.items()
    ),
)
add(
    "weight_sum_check",
    """SELECT *, CASE WHEN gewicht = 100 THEN 1 ELSE 0 END AS vollstaendig FROM
       (SELECT code_module, code_presentation,
               coalesce(sum(weight) FILTER (assessment_type <> 'Exam'), 0)::DOUBLE AS gewicht
        FROM exams GROUP BY 1, 2)""",
)
add(
    "unregistration_check",
    f"""SELECT code_module,
        {n_if("date_unregistration IS NOT NULL AND final_result <> 'Withdrawn'")} AS datum_ohne_abbruch,
        {n_if("date_unregistration IS NULL AND final_result = 'Withdrawn'")} AS abbruch_ohne_datum
        FROM registered JOIN info USING ({KEYS}) GROUP BY 1""",
)
add(
    "score_domain_check",
    f"""SELECT count(*) AS abgaben, {n_if("score < 4 OR score > 96")} AS score_ausserhalb,
        {n_if("score < 40")} AS score_nicht_bestanden,
        {n_if("is_banked NOT IN (0, 1)")} AS is_banked_ausserhalb FROM submitted""",
)

# Group sizes, shares and rates

SIZES = "SELECT code_module, count(*) AS einschreibungen, count(DISTINCT id_student) AS personen FROM info GROUP BY 1"
add("enrolments_vs_persons", SIZES)
add("repeat_surplus", f"SELECT code_module, einschreibungen - personen AS mehrfach FROM ({SIZES})")
add(
    "repeat_enrolments",
    """SELECT code_module, id_student, count(*) AS n_praesentationen FROM info GROUP BY 1, 2
       HAVING count(*) > 1 ORDER BY code_module, id_student LIMIT 10""",
)
add(
    "enrolment_lookup",
    """SELECT code_module, code_presentation, id_student, final_result, num_of_prev_attempts
       FROM info WHERE id_student IN (3, 4, 5, 6, 7, 8, 9) AND code_module = 'BUILDING'""",
)
for suffix, column in (("", "final_result"), ("_imd", "imd_band")):
    add(
        f"share_within_group{suffix}",
        f"""SELECT code_module, {column}, anzahl,
            {pct("anzahl", "sum(anzahl) OVER (PARTITION BY code_module)")} AS prozent
            FROM (SELECT code_module, {column}, count(*) AS anzahl FROM info GROUP BY 1, 2)""",
    )


def side_by_side(category: str, columns, label: str = "{0}") -> str:
    names = ("automobile", "building", "furniture")
    cells = ", ".join(c for m in names for c in columns(m, f"code_module = '{m.upper()}'"))
    return f"SELECT {label.format(category)} AS {category}, {cells} FROM info GROUP BY info.{category}"


def share_cells(counts: bool):
    def cells(name: str, here: str) -> list[str]:
        share = pct(n_if(here), f"(SELECT count(*) FROM info WHERE {here})") + f" AS {name}_prozent"
        return [f"{n_if(here)} AS {name}_anzahl", share] if counts else [share]

    return cells


def rate_cells(name: str, here: str) -> list[str]:
    passed = n_if(f"{here} AND {PASSED}")
    return [
        pct(passed, n_if(here)) + f" AS {name}_alle",
        pct(passed, n_if(f"{here} AND {FINISHED}")) + f" AS {name}_ohne",
    ]


def withdrawal_cells(name: str, here: str) -> list[str]:
    return [pct(n_if(f"{here} AND final_result = 'Withdrawn'"), n_if(here)) + f" AS {name}_abbruch"]


MISSING = "coalesce({0}, 'fehlend')"
add("side_by_side_share", side_by_side("imd_band", share_cells(True), MISSING))
add("side_by_side_share_age", side_by_side("age_band", share_cells(True)))
add("side_by_side_share_education", side_by_side("highest_education", share_cells(True)))
add("side_by_side_share_pct", side_by_side("region", share_cells(False)))
add(
    "conditional_share",
    f"""SELECT imd_band, count(*) AS anzahl,
        {pct(n_if("highest_education IN ('No Formal quals', 'Lower Than A Level')"), "count(*)")}
            AS prozent_unter_a_level FROM info WHERE imd_band IS NOT NULL GROUP BY 1""",
)
add(
    "flag_share",
    f"""SELECT code_module, count(*) AS einschreibungen, {n_if("disability = 'Y'")} AS mit_disability,
        {pct(n_if("disability = 'Y'"), "count(*)")} AS prozent_disability FROM info GROUP BY 1""",
)
ALL_RATE = pct(n_if(PASSED), "count(*)")
FINISHED_RATE = pct(n_if(PASSED), n_if(FINISHED))
add(
    "outcome_rate",
    f"""SELECT code_module, count(*) AS einschreibungen, {ALL_RATE} AS bestanden_alle_prozent,
        {n_if(FINISHED)} AS ohne_abbrecher, {FINISHED_RATE} AS bestanden_ohne_abbrecher_prozent
        FROM info GROUP BY 1""",
)
add(
    "outcome_rate_by_flag",
    f"""SELECT code_module, disability, count(*) AS einschreibungen, {ALL_RATE} AS bestanden_alle_prozent,
        {n_if(FINISHED)} AS ohne_abbrecher,
        {pct(n_if("final_result = 'Withdrawn'"), "count(*)")} AS abbruch_prozent,
        {FINISHED_RATE} AS bestanden_ohne_abbrecher_prozent FROM info GROUP BY 1, 2""",
)
add(
    "rate_gap",
    """SELECT code_module, round(n.alle - y.alle, 1) AS abstand_alle,
        round(n.ohne - y.ohne, 1) AS abstand_ohne_abbrecher
        FROM flags n JOIN flags y USING (code_module) WHERE n.disability = 'N' AND y.disability = 'Y'""",
    flags=f"SELECT code_module, disability, {ALL_RATE} AS alle, {FINISHED_RATE} AS ohne FROM info GROUP BY 1, 2",
)
add("side_by_side_rate", side_by_side("highest_education", rate_cells))
add("side_by_side_rate_imd", side_by_side("imd_band", rate_cells, MISSING))
add("side_by_side_withdrawal", side_by_side("imd_band", withdrawal_cells, MISSING))


def gradient(band: str, name: str) -> str:
    here = f"imd_band = '{band}'"
    passed = n_if(f"{here} AND {PASSED}")
    return f"""{pct(passed, n_if(here))} AS bestanden_alle_{name},
        {pct(passed, n_if(f"{here} AND {FINISHED}"))} AS bestanden_ohne_{name},
        {pct(n_if(f"{here} AND final_result = 'Withdrawn'"), n_if(here))} AS abbruch_{name}"""


add(
    "band_gradient",
    f"""SELECT code_module, {gradient("1-URGENT", "erstes")}, {gradient("5-LOW", "letztes")}
        FROM info WHERE imd_band IN ('1-URGENT', '5-LOW') GROUP BY 1""",
)

# Usage and report

add(
    "top_usage",
    f"""SELECT * FROM (
        SELECT code_module, activity_type, gesamtklicks,
               {pct("gesamtklicks", "sum(gesamtklicks) OVER (PARTITION BY code_module)")} AS klick_anteil_prozent,
               {pct("nutzende", "n")} AS nutzende_prozent,
               row_number() OVER (PARTITION BY code_module ORDER BY gesamtklicks DESC, activity_type)::INT AS rang
        FROM per_type JOIN (SELECT code_module, count(*) AS n FROM info GROUP BY 1) USING (code_module))
        WHERE rang <= 5""",
    per_type="""SELECT code_module, activity_type, sum(klicks)::BIGINT AS gesamtklicks, count(*) AS nutzende
        FROM usage_all GROUP BY 1, 2""",
)
add("clicks_by_type", "SELECT * FROM by_type")
add(
    "outcome_usage_ratio",
    f"""SELECT code_module, activity_type, {mean("ps", "pn")} AS klicks_bestanden,
        {mean("fs", "fn")} AS klicks_durchgefallen,
        ((200 * ps * fn + pn * fs) // nullif(2 * pn * fs, 0))::DOUBLE / 100 AS verhaeltnis
        FROM (SELECT code_module, activity_type,
                 (sum(klicks) FILTER ({PASSED}))::HUGEINT AS ps, ({n_if(PASSED)})::HUGEINT AS pn,
                 (sum(klicks) FILTER (final_result = 'Fail'))::HUGEINT AS fs,
                 ({n_if("final_result = 'Fail'")})::HUGEINT AS fn
              FROM by_type JOIN info USING ({KEYS}) WHERE {FINISHED} GROUP BY 1, 2)""",
)
add("clicks_from_start", "SELECT * FROM from_start")
add("early_clicks", "SELECT * FROM early")
add(
    "submissions",
    f"SELECT {KEYS}, abgaben, score_durchschnitt::DOUBLE AS score_durchschnitt FROM exam_results",
)
for name in ("enrolment_report", "report_view", "export_report"):
    add(name, "SELECT * FROM report")
add("export_early_clicks", "SELECT * FROM early")
add("export_clicks_by_type", "SELECT * FROM by_type")
add(
    "report_counts",
    f"SELECT code_module, count(*) AS zeilen, {n_if('klicks_gesamt = 0')} AS ohne_klicks FROM base GROUP BY 1",
)
add("report_materialised", f"SELECT code_module, {mean('s', 'n')} AS klicks_schnitt FROM module_totals")
for name, other in (
    ("report_view_means", "report_materialised"),
    ("report_refreshed", "report_materialised"),
    ("report_stored_counts", "report_counts"),
):
    ORACLES[name] = ORACLES[other]
add(
    "rebuild_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS tabelle, count(*) AS zeilen FROM {TYPED[name]}"
        for name in ("courses", "assessments", "vle", "student_info")
    ),
)
add(
    "report_key_duplicates",
    """SELECT 'einschreibung' AS schluessel, 0::BIGINT AS doppelte UNION ALL
       SELECT 'person', count(*) FROM
           (SELECT 1 FROM base GROUP BY code_module, id_student HAVING count(*) > 1)""",
)
OLDER = """SELECT * REPLACE (CASE WHEN id_student % 83 = 0 THEN -id_student ELSE id_student END AS id_student,
    CASE WHEN id_student % 31 = 0 THEN klicks_gesamt + 1 ELSE klicks_gesamt END AS klicks_gesamt,
    CASE WHEN id_student % 29 = 0 THEN coalesce(imd_band, 'unbekannt') ELSE imd_band END AS imd_band,
    CASE WHEN id_student % 37 <> 0 THEN score_durchschnitt END AS score_durchschnitt) FROM report"""
PASSED_COUNTS = """SELECT code_module, code_presentation, id_assessment, count(*) AS n,
    count(*) FILTER (score >= 40) AS passed FROM submitted JOIN exams USING (id_assessment)
    WHERE score IS NOT NULL GROUP BY 1, 2, 3"""
add(
    "pair_consistency",
    """SELECT code_module, code_presentation, a AS pruefung_a, b AS pruefung_b, n AS abgaben, round(chi, 6) AS chi_quadrat,
        round(sqrt(chi / n), 6) AS cramers_v, (chi > 3.841459)::INT AS auffaellig
        FROM (SELECT x.code_module, x.code_presentation, x.id_assessment AS a, y.id_assessment AS b, x.n + y.n AS n,
              coalesce((x.n + y.n) * pow(x.passed * (y.n - y.passed) - y.passed * (x.n - x.passed), 2)
                  / nullif(x.n::DOUBLE * y.n * (x.passed + y.passed) * (x.n + y.n - x.passed - y.passed), 0), 0) AS chi
              FROM counted x JOIN counted y USING (code_module, code_presentation)
              WHERE x.id_assessment < y.id_assessment)""",
    counted=PASSED_COUNTS,
)
add(
    "group_consistency",
    """SELECT code_module, count(*) AS pruefungen, sum(n)::BIGINT AS abgaben, round(any_value(chi), 6) AS chi_quadrat,
        count(*) - 1 AS freiheitsgrade, round(sqrt(any_value(chi) / sum(n)), 6) AS cramers_v
        FROM counted JOIN (
            SELECT code_module, coalesce(total * (sum(pow(passed, 2) / n) - pow(s, 2) / total) * total
                / nullif(s::DOUBLE * (total - s), 0), 0) AS chi
            FROM counted JOIN (SELECT code_module, sum(n) AS total, sum(passed) AS s FROM counted GROUP BY 1) USING (code_module)
            GROUP BY code_module, total, s
        ) USING (code_module) GROUP BY 1""",
    counted=PASSED_COUNTS,
)
add(
    "report_diff",
    """SELECT (SELECT count(*) FROM (FROM report EXCEPT FROM older)) AS nur_links,
        (SELECT count(*) FROM (FROM older EXCEPT FROM report)) AS nur_rechts,
        (SELECT count(*) FROM (FROM report EXCEPT ALL FROM older)) AS nur_links_mehrfach,
        (SELECT count(*) FROM (FROM older EXCEPT ALL FROM report)) AS nur_rechts_mehrfach""",
    older=OLDER,
)
REPORT_VALUES = (
    "gender age_band imd_band highest_education disability final_result bestanden klicks_gesamt aktive_tage abgaben "
    "score_durchschnitt klicks_diff_vom_modulschnitt"
).split()
DIFFERS = " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in REPORT_VALUES)
add(
    "report_changes",
    " UNION ALL ".join(
        [
            f"SELECT 'hinzugekommen' AS art, NULL::VARCHAR AS spalte, count(*) AS anzahl FROM report n ANTI JOIN older o USING ({KEYS})",
            f"SELECT 'entfallen', NULL, count(*) FROM older o ANTI JOIN report n USING ({KEYS})",
            f"SELECT 'geaendert', NULL, count(*) FROM report n JOIN older o USING ({KEYS}) WHERE {DIFFERS}",
            "SELECT 'schluessel_mehrfach', NULL, 0",
        ]
        + [
            f"""SELECT 'spalte', '{c}', count(*) FROM report n JOIN older o USING ({KEYS})
            WHERE n.{c} IS DISTINCT FROM o.{c}"""
            for c in REPORT_VALUES
        ]
    ),
    older=OLDER,
)
add(
    "report_refreshed_modules",
    f"""SELECT code_module, count(*) AS zeilen, {mean("sum(klicks_gesamt)", "count(*)")} AS klicks_schnitt,
        CASE WHEN code_module = 'BUILDING' THEN 1 ELSE 0 END AS neu_geschrieben FROM base GROUP BY 1""",
)
add(
    "csv_roundtrip",
    f"""SELECT code_module, {RAW_BAND} AS imd_band, final_result, count(*) AS anzahl
        FROM info GROUP BY 1, 2, 3""",
)

# Features and models

add(
    "model_base",
    f"""SELECT {KEYS}, bestanden, imd, bildung, alter_35plus, disability_ja, weiblich, klicks_gesamt
        FROM modelled""",
)
add("model_base_size", "SELECT count(*) AS zeilen FROM modelled")
add("zscore_log1p", f"SELECT {KEYS}, klicks_gesamt, round(klicks_z, 6) AS klicks_z FROM featured")
add("features_early", f"SELECT {KEYS}, klicks_frueh, round(frueh_z, 6) AS frueh_z FROM featured")
add("clicks_by_type_wide", "SELECT * FROM wide")
add(
    "activity_profile",
    f"""SELECT {KEYS}, sum(sum_click)::BIGINT AS klicks_gesamt,
    (sum(sum_click) FILTER (date <= 27))::BIGINT AS klicks_frueh, {", ".join(
        f"(sum(sum_click) FILTER (activity_type = '{t}'))::BIGINT AS {t}" for t in TYPES
    )} FROM clicks c JOIN sites s USING (id_site) WHERE date >= 0
    GROUP BY c.code_module, c.code_presentation, c.id_student""".replace(
        KEYS, "c.code_module, c.code_presentation, c.id_student", 1
    ),
)
LEVELS = {
    "bildung=A_Level": "(bildung = 'A_Level')::INT::DOUBLE",
    "bildung=Studium": "(bildung = 'Studium')::INT::DOUBLE",
    "code_module=BUILDING": "(code_module = 'BUILDING')::INT::DOUBLE",
    "code_module=FURNITURE": "(code_module = 'FURNITURE')::INT::DOUBLE",
    "code_module=HOUSEHOLD": "(code_module = 'HOUSEHOLD')::INT::DOUBLE",
    "code_module=MACHINERY": "(code_module = 'MACHINERY')::INT::DOUBLE",
    "imd": "imd::DOUBLE",
    "alter_35plus": "alter_35plus::DOUBLE",
    "disability_ja": "disability_ja::DOUBLE",
    "weiblich": "weiblich::DOUBLE",
}
add(
    "design_matrix",
    "SELECT bestanden::DOUBLE AS bestanden, "
    + ", ".join(f'{e} AS "{t}"' for t, e in LEVELS.items())
    + ", count(*) AS zeilen FROM modelled GROUP BY ALL",
)
# Titles and labels of the models, as the fitted tables show them.
MODELS = {
    "m1": ("Modell 1: nur Demografie", {}),
    "m2": ("Modell 2: + Klicks gesamtes Semester", {"klicks_z": "klicks_z"}),
    "m3": ("Modell 3: + Klicks erste 4 Wochen", {"frueh_z": "frueh_z"}),
    "m4b": (
        "Modell 4b: + ECONOMY & PROMO",
        {"ECONOMY_z": "ECONOMY_z", "PROMO_z": "PROMO_z"},
    ),
}


Z_95 = "1.959963984540054"


def design(terms: dict[str, str], grouped: bool) -> str:
    """Outcome y, terms x0.. and the number w of equal rows."""
    source = "modelled" if grouped else "featured"
    columns = ", ".join(f"{e} AS x{i}" for i, e in enumerate(["1.0::DOUBLE", *terms.values()]))
    rows = f"SELECT bestanden::DOUBLE AS y, {columns} FROM {source}"
    counted = f"SELECT *, count(*)::DOUBLE AS n FROM ({rows}) GROUP BY ALL"
    return "MATERIALIZED " + (counted if grouped else f"SELECT *, 1.0::DOUBLE AS n FROM ({rows})")


def fit_tables(terms: dict[str, str], grouped: bool, suffix: str = "") -> dict[str, str]:
    """The regression tables; ``suffix`` tells several models in one statement apart."""
    tables = {"design": design(terms, grouped)}
    tables |= newton_tables("design", len(terms) + 1, "n")
    if not suffix:
        return tables
    names = sorted(tables, key=len, reverse=True)
    renamed = re.compile(r"\b(" + "|".join(names) + r")\b")
    return {
        f"{name}{suffix}": renamed.sub(lambda hit: hit.group(0) + suffix, text)
        for name, text in tables.items()
    }


def coefficients(terms: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i}::INT AS position, '{term}' AS term, b{i} AS b, s{i} AS se FROM {table}"
        for i, term in enumerate(["Intercept", *terms])
    )


ODDS = f"""SELECT position, term, round(exp(b), 3) AS "OR", round(exp(b - {Z_95} * se), 3) AS ci_unten,
    round(exp(b + {Z_95} * se), 3) AS ci_oben, round({two_sided_p("abs(b / se)")}, 3) AS p FROM"""

everything: dict[str, str] = {}
for name, (title, activity) in MODELS.items():
    terms = LEVELS | activity
    add(
        f"logit_{name}",
        " UNION ALL ".join(
            f"SELECT '{t}' AS term, round(s{i}, 3) AS summe FROM sums"
            for i, t in enumerate(["Intercept", *terms])
        ),
        design=design(terms, not activity),
        sums="SELECT "
        + ", ".join(f"sum(x{i} * y * n) AS s{i}" for i in range(len(terms) + 1))
        + " FROM design",
    )
    add(
        f"odds_ratio_{name}",
        f"{ODDS} ({coefficients(terms, 'fitted')})",
        **fit_tables(terms, not activity),
    )
    everything |= fit_tables(terms, not activity, f"_{name}")
add(
    "effect_size_label",
    f"""SELECT term, CASE WHEN "OR" < 1.68 THEN 'sehr klein' WHEN "OR" < 3.47 THEN 'klein'
               WHEN "OR" < 6.71 THEN 'mittel' ELSE 'groß' END AS effekt,
           CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
                ELSE 'n.s.' END AS signifikanz
        FROM (SELECT term, exp(b) AS "OR", {two_sided_p("abs(b / se)")} AS p FROM ({coefficients(LEVELS, "fitted")}))""",
    **fit_tables(LEVELS, True),
)
add(
    "pseudo_r2",
    " UNION ALL ".join(
        f"""SELECT '{title}' AS modell, round(1 - deviance / null_deviance, 6) AS pseudo_r2
        FROM deviances_{name}"""
        for name, (title, _) in MODELS.items()
    ),
    **everything,
)
# As above.
TITLES = {
    "imd": "IMD (1=arm .. 10=reich)",
    "bildung=A_Level": "Bildung: A-Level (Ref: unter A-Level)",
    "bildung=Studium": "Bildung: Studium (Ref: unter A-Level)",
    "alter_35plus": "Alter 35+ (Ref: unter 35)",
    "disability_ja": "Disability: ja",
    "weiblich": "Geschlecht: weiblich",
    "klicks_z": "Klicks gesamtes Semester (z)",
    "frueh_z": "Klicks erste 4 Wochen (z)",
}
LABEL = "CASE term " + " ".join(f"WHEN '{t}' THEN '{text}'" for t, text in TITLES.items()) + " ELSE term END"
add(
    "forest_table",
    f"""SELECT modell, zeile, {LABEL} AS bezeichnung, "OR", round("OR" - ci_unten, 3) AS fehler_links,
        round(ci_oben - "OR", 3) AS fehler_rechts, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS signifikant,
        round(min(ci_unten) OVER () * 0.85, 4) AS x_min, round(max(ci_oben) OVER () * 1.15, 4) AS x_max
        FROM stacked""",
    **everything,
    stacked=" UNION ALL ".join(
        f"""SELECT '{title}' AS modell, {len(LEVELS | activity) + 1} - position AS zeile, *
        FROM ({ODDS} ({coefficients(LEVELS | activity, f"fitted_{name}")})) WHERE term <> 'Intercept'"""
        for name, (title, activity) in MODELS.items()
    ),
)
add(
    "logit_single_flag",
    """SELECT 'Intercept' AS term, round(exp(ln(b / d)), 3) AS "OR",
              round(exp(ln(b / d) - 1.959963984540054 * sqrt(1 / b + 1 / d)), 3) AS ci_unten,
              round(exp(ln(b / d) + 1.959963984540054 * sqrt(1 / b + 1 / d)), 3) AS ci_oben FROM cells
       UNION ALL
       SELECT 'disability_ja', round(a * d / (b * c), 3),
              round(exp(ln(a * d / (b * c)) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 3),
              round(exp(ln(a * d / (b * c)) + 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 3)
       FROM cells""",
    cells="""SELECT sum(disability_ja * bestanden)::DOUBLE AS a,
        sum((1 - disability_ja) * bestanden)::DOUBLE AS b,
        sum(disability_ja * (1 - bestanden))::DOUBLE AS c,
        sum((1 - disability_ja) * (1 - bestanden))::DOUBLE AS d FROM modelled""",
)
PAIRS = [(a, b) for i, a in enumerate(TYPES) for b in TYPES[i + 1 :]]
add(
    "type_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS merkmal_a, '{b}' AS merkmal_b, round(corr({a}, {b}), 4) AS r FROM paired"
        for a, b in PAIRS
    ),
)
add(
    "identifiability_report",
    " UNION ALL ".join(
        [
            f"""SELECT 'korrelation' AS pruefung, '{a}' AS merkmal_a, '{b}' AS merkmal_b_oder_gruppe,
            round(corr({a}, {b}), 4) AS wert,
            CASE WHEN abs(round(corr({a}, {b}), 4)) >= 0.1 THEN 1 ELSE 0 END AS auffaellig FROM paired"""
            for a, b in PAIRS
        ]
        + [
            f"""SELECT 'konstant', '{t}', code_module, NULL, (min({t}) = max({t}))::INT
            FROM paired GROUP BY code_module"""
            for t in TYPES
        ]
        + [f"SELECT 'rang', '', '', {len(TYPES) + 1}::DOUBLE, 0"]
    ),
)


def elimination(rows: str, size: int, tolerance: str = "1e-9") -> dict[str, str]:
    """Table ``reduced``: Gauss-Jordan on the cross products of x0.. of ``rows``, a{i}_{j}, and per term whether d{i} a pivot was left."""
    every = [(i, j) for i in range(size) for j in range(size)]
    sums = [f"sum(x{i} * x{j})::DOUBLE AS a{i}_{j}" for i, j in every] + [f"sum(x{i} * x{i})::DOUBLE AS g{i}" for i in range(size)]
    tables = {"e_0": f"SELECT {', '.join(sums)} FROM {rows}"}
    for k in range(size):
        pivot = f"a{k}_{k} > {tolerance} * g{k}"
        cells = [
            f"""CASE WHEN NOT ({pivot}) THEN a{i}_{j} {f"ELSE a{k}_{j} / a{k}_{k}" if i == k else
            f"ELSE a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}"} END AS a{i}_{j}"""
            for i, j in every
        ]
        kept = [f"g{i}" for i in range(size)] + [f"d{i}" for i in range(k)]
        tables[f"e_{k + 1}"] = f"SELECT {', '.join(cells + kept)}, ({pivot})::INT AS d{k} FROM e_{k}"
    tables["reduced"] = f"SELECT *, {' + '.join(f'd{i}' for i in range(size))} AS rang FROM e_{size}"
    return {name: f"MATERIALIZED {text}" for name, text in tables.items()}


DESIGN = ["(Konstante)", *TYPES, "summe"]
add(
    "design_rank",
    " UNION ALL ".join(
        [
            f"""SELECT '{term}' AS term, d{k} AS unabhaengig, NULL::VARCHAR AS abhaengig_von, NULL::DOUBLE AS koeffizient,
            rang::INT AS rang, {len(DESIGN)} AS terme FROM reduced WHERE d{k} = 1"""
            for k, term in enumerate(DESIGN)
        ]
        + [
            f"""SELECT '{term}', d{k}, '{other}', round(a{i}_{k}, 6), rang::INT, {len(DESIGN)} FROM reduced
            WHERE d{k} = 0 AND d{i} = 1 AND round(a{i}_{k}, 6) <> 0"""
            for k, term in enumerate(DESIGN)
            for i, other in enumerate(DESIGN[:k])
        ]
    ),
    designed=f"""SELECT 1 AS x0, {", ".join(f"{t} AS x{k}" for k, t in enumerate(TYPES, 1))},
        {" + ".join(TYPES)} AS x{len(TYPES) + 1} FROM paired""",
    **elimination("designed", len(DESIGN)),
)
add(
    "group_mean_z",
    """SELECT alter_35plus, count(*) AS anzahl, round(avg(klicks_z), 4) AS mittelwert
       FROM featured GROUP BY 1""",
)
