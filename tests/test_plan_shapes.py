"""Plan-shape checks that matter at scale, on every registered batch query."""

import re

import pytest

import __spark_entry__ as entry
from registry_analytics.plans.catalog import QUERIES
from registry_analytics.sources import fixtures

from .conftest import SF_SMALL

FITTED = {"als_rmse", "als_tuned", "als_tuned_b", "als_tuned_c", "user_mean_rmse", "item_index",
          "item_index_hot"}
SKIP = FITTED | {"stream_study_types"}
NAMES = sorted(n for n in QUERIES if n not in SKIP)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def full_metadata(spark):
    # plan strings shorten scan metadata (pushed filters) to 100 characters by default
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_or_nested_loop_join(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NAMES)
def test_groupings_combine_map_side(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_SMALL))
    finals = len(re.findall(r"HashAggregate\(keys=\[[^\]]+\], functions=\[(count|sum|avg)\(",
                            plan))
    partials = len(re.findall(r"functions=\[partial_", plan))
    assert partials >= finals


def test_question_reads_only_its_column(spark):
    plan = plan_text(entry.queries()["study_types"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(s == "Type:string" for s in schemas)


@pytest.mark.parametrize("name", ["completed_by_month", "sql_completed_by_month"])
def test_month_filters_reach_the_scan(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_SMALL))
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan))
    assert "EqualTo(Status,COMPLETED)" in pushed
    assert "StringStartsWith(Completion,1998)" in pushed
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["Status:string,Completion:string"]


@pytest.mark.parametrize("name", ["top_unlisted_sponsors", "sql_top_unlisted_sponsors"])
def test_exclusion_stays_after_the_aggregate_without_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, SF_SMALL)
        plan = plan_text(df)
        assert "LeftOuter" in plan and "LeftAnti" not in plan
        # partial aggregation happens before the first shuffle of trial rows
        assert "partial_count" in plan
        assert len(df.collect()) == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_building_a_query_runs_no_job(spark):
    fixtures.materialize(spark, SF_SMALL)
    tracker = spark.sparkContext.statusTracker()
    for name in NAMES:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        try:
            QUERIES[name](spark, SF_SMALL)
            # reading the schema of an input is the only job a plan may need
            inputs = 2 if "unlisted" in name else 1
            assert len(tracker.getJobIdsForGroup(f"build-{name}")) <= inputs, name
        finally:
            spark.sparkContext.setJobGroup("tests", "tests")
