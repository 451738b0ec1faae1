"""Plan checks: pushdown, pruning, broadcast of bounded sides, partial top-k, no
single-partition windows, no row-at-a-time Python UDFs."""

import pytest

import __spark_entry__ as entry
from small_data import SF_SMALL


def _plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_supersession_prunes_text_and_uses_no_window(spark):
    plan = _plan(spark, "c8_supersede")
    scans = [l for l in plan.split("\n") if "FileScan parquet" in l and "doc_id" in l]
    assert scans and all("text" not in l.split("ReadSchema")[-1] for l in scans)
    assert "Window" not in plan and "BatchEvalPython" not in plan


def test_trusted_filter_is_a_broadcast_semi_join(spark):
    plan = _plan(spark, "b3_trusted_only")
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_search_many_limits_before_the_shuffle(spark):
    plan = _plan(spark, "k5_search_many")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ordinal_has_no_single_partition_step(spark):
    plan = _plan(spark, "e1_with_ordinal")
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["h9_extract_job", "f1_curated_order", "b5_normalize_feedback",
                                  "h4_batch_prompts", "i6_review_evidence"])
def test_no_row_python_udf_or_global_window(spark, name):
    plan = _plan(spark, name)
    assert "BatchEvalPython" not in plan
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
