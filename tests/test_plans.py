"""What the physical plans must and must not hold."""

import re

import pytest

from listloom.operators import competitors, dedup, rate
from listloom.plans import catalog
from listloom.plans.views import businesses, view

QUERIES = catalog.QUERIES
USES_PYTHON = {"w7_rate_trace", "x32_string_ratio", "x33_similarity_score"}
WRITES = re.compile(r"^(s\d|t\d|c1|c3|c4|j3)")  # run jobs of their own before the plan exists


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not WRITES.match(n)])
def test_no_cross_join_and_no_row_python(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in USES_PYTHON:
        assert "Python" not in plan and "Pandas" not in plan


def test_first_per_key_limits_before_the_shuffle(spark, sf_dir):
    plan = plan_of(dedup.first_per_key(dedup.with_dedup_key(businesses(spark, sf_dir))))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange hashpartitioning") <= 2  # one of them builds the test records


def test_merge_combines_before_the_shuffle(spark, sf_dir):
    plan = plan_of(dedup.merged_fields(dedup.with_dedup_key(businesses(spark, sf_dir))))
    assert "HashAggregate(keys=[dedup_key" in plan and "partial_count" in plan


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = plan_of(rate.totals_per_key(view(spark, sf_dir, "requests")))
    assert re.search(r"ReadSchema: struct<user_id:bigint>", plan)


def test_duplicates_read_their_records_once(spark, sf_dir):
    plan = plan_of(dedup.remove_duplicates(businesses(spark, sf_dir)))
    # only the keyed records that were written, none of the tables they are made from
    assert "customer.parquet" not in plan and "orders.parquet" not in plan and "keyed-" in plan


def test_crowded_cubes_may_be_split(spark, sf_dir):
    plan = plan_of(competitors.find_competitors(businesses(spark, sf_dir)))
    assert "REPARTITION" not in plan and plan.count("spots-") > 1


def test_summary_is_one_pass(spark, sf_dir):
    plan = plan_of(QUERIES["a2_contact_counts"](spark, sf_dir))
    assert "Exchange SinglePartition" in plan and "Window" not in plan
