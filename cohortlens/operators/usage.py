"""Click usage per enrolment and material type.

Clicks are summed per enrolment before they meet the enrolments, so what a join moves is one row per
enrolment (and type), not one per click. The types of the sites are broadcast after a check of their
number, so clicks are summed per enrolment and type in the map stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numeric import mean_of, percent, ratio, rounded
from cohortlens.functions.ordering import ascending, descending
from cohortlens.functions.sized import small_side
from cohortlens.operators.rates import Outcome
from cohortlens.sources.schemas import ENROLMENT, FAILED

#: Sites up to which their types are broadcast; beyond, Spark joins as it sees fit.
MAX_SITES = 100_000


def within(events: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """The events from day ``since`` to day ``until``, both included."""
    if since is not None:
        events = events.where(F.col("date") >= since)
    if until is not None:
        events = events.where(F.col("date") <= until)
    return events


def usage_per_entity(
    events: DataFrame,
    sites: DataFrame | None = None,
    keys: Sequence[str] = ENROLMENT,
    since: int | None = None,
    until: int | None = None,
    types: Sequence[str] | None = None,
    name: str = "klicks",
) -> DataFrame:
    """Summed clicks per enrolment, and per activity type if ``sites`` is given.

    Sites are few beside clicks. Up to ``MAX_SITES`` of them are broadcast, so that the clicks, many of
    them on one home page, are not shuffled by site.
    """
    events = within(events, since, until)
    if sites is None:
        return events.groupBy(*keys).agg(F.sum("sum_click").alias(name))
    if types is not None:
        sites = sites.where(F.col("activity_type").isin(*types))
    return (
        events.join(small_side(sites.select("id_site", "activity_type"), MAX_SITES), "id_site")
        .groupBy(*keys, "activity_type")
        .agg(F.sum("sum_click").alias(name))
    )


def clicks_from_start(
    events: DataFrame, keys: Sequence[str] = ENROLMENT, since: int = 0
) -> DataFrame:
    """Summed clicks and distinct active days per enrolment from day ``since`` on."""
    return (
        within(events, since)
        .groupBy(*keys)
        .agg(
            F.sum("sum_click").alias("klicks_gesamt"),
            F.count_distinct("date").alias("aktive_tage"),
        )
    )


def early_clicks(
    events: DataFrame, keys: Sequence[str] = ENROLMENT, since: int = 0, until: int = 27
) -> DataFrame:
    """Summed clicks per enrolment in the first weeks."""
    return usage_per_entity(events, None, keys, since, until, name="klicks_frueh")


def top_usage(
    events: DataFrame,
    sites: DataFrame,
    enrolments: DataFrame,
    group: str = "code_module",
    n: int = 5,
    keys: Sequence[str] = ENROLMENT,
) -> DataFrame:
    """The ``n`` most clicked activity types per group, with click share and reach.

    Counts every click, also before the start and of withdrawn students. Reach is the percentage of
    enrolments that used the type at least once. Ties go by type name. The windows see a row per group
    and type.
    """
    per_type = (
        usage_per_entity(events, sites, keys)
        .groupBy(group, "activity_type")
        .agg(F.sum("klicks").alias("gesamtklicks"), F.count("*").alias("nutzende"))
        .withColumn("alle_klicks", F.sum("gesamtklicks").over(Window.partitionBy(group)))
    )
    sizes = enrolments.groupBy(group).agg(F.count("*").alias("einschreibungen"))
    shares = (
        per_type.join(small_side(sizes), group)
        .select(
            group,
            "activity_type",
            "gesamtklicks",
            percent(F.col("gesamtklicks"), F.col("alle_klicks")).alias("klick_anteil_prozent"),
            percent(F.col("nutzende"), F.col("einschreibungen")).alias("nutzende_prozent"),
        )
    )
    most_first = Window.partitionBy(group).orderBy(
        *descending("gesamtklicks"), *ascending("activity_type")
    )
    return (
        shares.withColumn("rang", F.row_number().over(most_first))
        .where(F.col("rang") <= n)
        .orderBy(*ascending(group, "rang"))
    )


def outcome_usage_ratio(
    usage: DataFrame,
    enrolments: DataFrame,
    types: Sequence[str],
    keys: Sequence[str] = ENROLMENT,
    group: str = "code_module",
    outcome: Outcome = Outcome(),
    failure: str = FAILED,
) -> DataFrame:
    """Mean clicks of passed and failed users of each type, and how many times more the passed click.

    ``usage`` has one row per enrolment and type it used. Withdrawn enrolments are left out. The
    ratio is taken before rounding; NULL where nobody failed or the failed have no clicks.
    """
    finished = enrolments.where(outcome.finished).select(
        *keys, outcome.succeeded.alias("passed"), (F.col(outcome.column) == failure).alias("failed")
    )
    passed = mean_of(F.when(F.col("passed"), F.col("klicks")))
    failed = mean_of(F.when(F.col("failed"), F.col("klicks")))
    return (
        usage.where(F.col("activity_type").isin(*types))
        .join(finished, list(keys))
        .groupBy(group, "activity_type")
        .agg(
            rounded(passed, 1).alias("klicks_bestanden"),
            rounded(failed, 1).alias("klicks_durchgefallen"),
            ratio(passed, failed).alias("verhaeltnis"),
        )
        .orderBy(*ascending(group), *descending("verhaeltnis"), *ascending("activity_type"))
    )


def submissions(
    submitted: DataFrame, assessments: DataFrame, keys: Sequence[str] = ENROLMENT
) -> DataFrame:
    """Number of submissions and mean score per enrolment; the assessment supplies the module."""
    courses = assessments.select("id_assessment", "code_module", "code_presentation")
    return (
        submitted.join(courses, "id_assessment")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("abgaben"),
            rounded(mean_of(F.col("score"), 2), 1).alias("score_durchschnitt"),
        )
    )


def activity_profile(
    events: DataFrame,
    sites: DataFrame,
    types: Sequence[str],
    keys: Sequence[str] = ENROLMENT,
    early_until: int = 27,
) -> DataFrame:
    """All, early and per-type clicks of each enrolment, in one pass over the events.

    Holds what ``usage_per_entity``, ``early_clicks`` and ``clicks_by_type_wide`` give from the course
    start on, without reading the clicks three times. Events of a site that is not listed belong to
    no type.
    """
    clicks, type_of = F.col("sum_click"), F.col("activity_type")
    return (
        within(events, 0)
        .join(sites.select("id_site", "activity_type"), "id_site", "left")
        .groupBy(*keys)
        .agg(
            F.sum(clicks).alias("klicks_gesamt"),
            F.sum(F.when(F.col("date") <= early_until, clicks)).alias("klicks_frueh"),
            *[F.sum(F.when(type_of == name, clicks)).alias(name) for name in types],
        )
    )


def clicks_by_type_wide(
    usage: DataFrame, types: Sequence[str], keys: Sequence[str] = ENROLMENT
) -> DataFrame:
    """One column of clicks per type, 0 where unused, from one row per enrolment and type.

    The value of a cell is the mean of its rows, as usual for a pivot; one row per cell is expected.
    """
    cells = [
        F.avg(F.when(F.col("activity_type") == name, F.col("klicks"))).alias(name) for name in types
    ]
    return usage.groupBy(*keys).agg(*cells).fillna(0, subset=list(types))
