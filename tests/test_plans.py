"""What no plan may contain."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from tracemill.plans.queries import QUERIES

# Write files or run streams when built; their plans only read those files back.
EAGER = {"streamed_scores", "streamed_episodes", "streamed_retrieval", "result_history", "result_tables", "queries_from_csv", "scored_from_files", "episode_store", "example_file"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins_and_no_row_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    # One partition is only fit for the one-row list of writing tools.
    for line in plan.splitlines():
        if "SinglePartition" in line:
            assert "collect_set(regexp_replace(tool" in plan


def test_pruned_scan(spark):
    plan = entry.queries()["iteration_limit_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value#" not in plan


def test_hot_groups_are_limited_before_the_shuffle(spark):
    plan = entry.queries()["few_shot_picks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_null_id_is_shuffled_by_entity(spark):
    """Actions without an id look nothing up, so they must not gather on one key; whole traces are shuffled once, by their gold key."""
    import re

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["scored_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    keys = [re.sub(r"#\d+L?", "", b) for b in by]
    assert any(k.startswith("target, _key") for k in keys) and not any("entity_id" in k for k in keys)
    assert not any(k.startswith("run_id") for k in keys)
