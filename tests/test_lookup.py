import pytest
from pyspark.sql import functions as F

from parley.operators.lookup import lookup_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("cut", [dict(), dict(hot_rows=20, seg_rows=7)])
def test_same_as_a_plain_join(spark, how, cut):
    big = spark.range(300).select(
        F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 40).cast("long").alias("k"),
        F.col("id").alias("v"),
    )
    small = spark.createDataFrame([(k, k * 10) for k in range(0, 40, 3)] + [(1, 5)], "k long, w long")
    got = lookup_join(big, small, "k", how, **cut)
    want = big.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
