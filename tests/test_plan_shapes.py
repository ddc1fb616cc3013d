"""Physical-plan checks: pruning reaches the scan, no single-partition exchange
over data-sized inputs, partial aggregation before shuffles, limit pushdown."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "filtered_topk", "stop_at_first_failure", "after_last_reset", "mean_impute_by_group", "file_stats",
    "pivot_last_wins", "hash_embed", "upsert_latest", "validate_vocab", "fence_json", "tumbling_concat",
])
def test_no_single_partition_exchange(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "SinglePartition" not in plan, plan


def test_scan_prunes_columns(spark):
    plan = _plan(entry.queries()["map_bool"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan


def test_partial_aggregation(spark):
    plan = _plan(entry.queries()["pivot_last_wins"](spark, SF))
    assert "partial_max_by" in plan or "partial_pivotfirst" in plan
    plan = _plan(entry.queries()["file_stats"](spark, SF))
    assert plan.count("HashAggregate") >= 2


def test_topk_window_group_limit(spark):
    plan = entry.queries()["filtered_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
