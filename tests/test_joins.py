"""join_small: broadcast under the limit, salted join above it, same rows either way."""

import pytest

from feedmine.operators.joins import join_small


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_salted_equals_broadcast(spark, how):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "repo string, v long")
    small = spark.createDataFrame([("a", 10), ("c", 30)], "repo string, cut long")
    cols = big.columns + ([] if how in ("left_semi", "left_anti") else ["cut"])
    b = sorted(tuple(r) for r in join_small(big, small, ["repo"], how).select(*cols).collect())
    s = sorted(tuple(r) for r in join_small(big, small, ["repo"], how, limit_rows=0, salt_buckets=7,
                                            salt_col="v").select(*cols).collect())
    assert b == s and len(b) > 0
