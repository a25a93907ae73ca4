"""The shape of the physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from cohortlens.functions.sized import TooManyLevels, distinct_values, small_side
from cohortlens.plans.queries import QUERIES
from cohortlens.session import TASK_BYTES, byte_count
from cohortlens.sources import standins
from conftest import plan_of

LAZY = [
    "share_within_group",
    "side_by_side_share",
    "outcome_rate",
    "outcome_usage_ratio",
    "clicks_from_start",
    "submissions",
    "report_view",
    "orphans_site",
    "fk_violations",
    "clean_student_vle",
    "activity_profile",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_and_no_python(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", plan)


@pytest.mark.parametrize("name", ["share_within_group", "outcome_rate", "clicks_from_start", "orphans_site"])
def test_groupings_combine_before_the_shuffle(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "HashAggregate" in plan and "partial_" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_scan_reads_needed_columns_only(spark, folder):
    plan = plan_of(QUERIES["early_clicks"](spark, folder))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = next(s for s in schemas if "l_orderkey" in s)
    assert "l_extendedprice" not in lineitem and "l_partkey" not in lineitem
    assert "Filter" in plan and "% 300" in plan


def test_module_filter_reaches_the_scan(spark, folder):
    plan = plan_of(QUERIES["clean_student_vle"](spark, folder))
    assert re.search(r"PushedFilters: \[.*In\(c_mktsegment", plan)


def test_top_k_is_limited_per_group(spark, folder):
    assert "WindowGroupLimit" in plan_of(QUERIES["top_usage"](spark, folder))


def test_first_repeats_are_taken_without_a_full_sort(spark, folder):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["repeat_enrolments"](spark, folder))


@pytest.fixture
def nothing_small(spark):
    """As at scale: no table is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clicks_are_counted_per_key_before_the_anti_join(spark, folder, nothing_small):
    plan = plan_of(QUERIES["orphans_site"](spark, folder))
    assert "partial_count(1)" in plan[plan.index("LeftAnti") :]


def test_large_tables_still_give_the_same(spark, folder, nothing_small):
    names = ["orphans_site", "share_within_group", "top_usage", "report_view", "side_by_side_share"]
    large = [sorted(map(str, QUERIES[name](spark, folder).collect())) for name in names]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert large == [sorted(map(str, QUERIES[name](spark, folder).collect())) for name in names]


def test_group_totals_reuse_the_counts(spark, folder, nothing_small):
    df = QUERIES["share_within_group"](spark, folder)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange [code_module" in final
    assert len(re.findall(r"FileScan parquet \[o_custkey", final)) == 1


def test_enrolments_are_not_made_in_the_task_of_the_nations(spark, folder):
    df = standins.student_info(spark, folder)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "SortMergeJoin [id_student" in final and "BroadcastHashJoin [id_student" not in final
    assert not re.search(r"FileScan parquet \[n_nationkey", final)  # counted before, and broadcast


@pytest.fixture
def own_bounds(spark):
    saved = {key: spark.conf.get(key) for key in TASK_BYTES}
    yield
    for key, value in saved.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("bound", ["64MB", "134217728b", "1g", "16777217"])
def test_reading_a_table_bounds_its_tasks(spark, folder, own_bounds, bound):
    for key in TASK_BYTES:
        spark.conf.set(key, bound)
    assert byte_count(spark.conf.get("spark.sql.files.maxPartitionBytes")) > max(TASK_BYTES.values())
    standins.star_table(spark, folder, "region")
    assert {key: byte_count(spark.conf.get(key)) for key in TASK_BYTES} == TASK_BYTES


def test_smaller_bounds_stay(spark, folder, own_bounds):
    for key in TASK_BYTES:
        spark.conf.set(key, "64k")
    standins.star_table(spark, folder, "region")
    assert {spark.conf.get(key) for key in TASK_BYTES} == {"64k"}


def test_size_check_refuses_to_broadcast(spark, nothing_small):
    small = spark.range(10).join(small_side(spark.range(50), 50), "id")
    large = spark.range(10).join(small_side(spark.range(50), 49), "id")
    assert "BroadcastHashJoin" in plan_of(small) and "BroadcastHashJoin" not in plan_of(large)
    assert small.count() == large.count() == 10


def test_distinct_values_are_whole_or_refused(spark):
    assert distinct_values(spark.range(150), "id") == list(range(150))
    with pytest.raises(TooManyLevels):
        distinct_values(spark.range(150), "id", max_levels=149)