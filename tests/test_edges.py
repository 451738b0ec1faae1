"""Edge rules: batch size (E2), context budget (E3), feedback cap (D2), session preparation."""

import pytest
from pyspark.sql import functions as F

from feedmine.operators import feedback as fb
from feedmine.operators import review as rv
from feedmine.operators.ordering import assign_batches
from feedmine.session import prepare


def test_batches_span_and_size_checked(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "ordinal")
    got = sorted((r["ordinal"], r["batch_id"], r["pos"]) for r in assign_batches(df, 4).collect())
    assert got[-1] == (9, 2, 1) and got[4] == (4, 1, 0)
    with pytest.raises(ValueError):
        assign_batches(df, 0)


def test_context_budget_counts_prefix_not_separators(spark):
    parts = spark.createDataFrame([("r", 1, 0, "a", "x" * 10), ("r", 1, 1, "b", "y" * 10),
                                   ("r", 2, 0, "a", "z" * 30)],
                                  "repo string, pr_number long, pos long, path string, text string")
    # "File: a\n" is 8 characters: PR 1 totals 36, PR 2 totals 38
    ctx, rej = rv.within_budget(parts, 36)
    assert [r["pr_number"] for r in ctx.collect()] == [1]
    assert ctx.first()["context"] == "File: a\n" + "x" * 10 + "\n\n" + "File: b\n" + "y" * 10
    assert [r["pr_number"] for r in rej.collect()] == [2]


def test_feedback_cap_allows_equal(spark):
    df = spark.createDataFrame([("r", 1)] * 3 + [("r", 2)] * 4, "repo string, pr_number long")
    assert [(r["pr_number"], r["n"]) for r in fb.check_feedback_cap(df, 3).collect()] == [(2, 4)]
    with pytest.raises(ValueError, match="limit is 3"):
        fb.enforce_feedback_cap(df, 3)


def test_prepare_sets_header_dedup(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    prepare(spark)
    m = spark.range(1).select(F.map_from_arrays(F.array(F.lit("A"), F.lit("a")),
                                                 F.array(F.lit("1"), F.lit("2"))).alias("m"))
    assert m.select(F.transform_keys("m", lambda k, v: F.lower(k))["a"]).first()[0] == "2"
