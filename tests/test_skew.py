"""Joins with a key that holds a third of all rows: results unchanged, tasks even."""

import pytest
from pyspark.sql import functions as F

from tallymart.operators import skew
from tallymart.operators.shaping import with_total


@pytest.fixture
def wide(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_table(spark, n=60_000):
    # Seller 7 and product 3 each hold a third of all rows; repeated rows included.
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("seller_id"),
        F.when(F.col("id") % 3 == 1, F.lit(3)).otherwise(F.col("id") % 7000).alias("product_id"),
        (F.col("id") % 11).alias("amount"),
    ).union(spark.range(100).select(F.lit(7).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long")))


def largest_share(frame):
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_totals_of_hot_keys(wide):
    table = hot_table(wide)
    assert skew.heavy_keys(table, ["seller_id"]) and skew.heavy_keys(table, ["product_id"])
    for key in ("seller_id", "product_id"):
        got = with_total(table, [key], "n")
        plain = table.join(table.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
        assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert largest_share(got) < 0.1 < largest_share(plain)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_any_join_of_a_row_alone(wide, how):
    table = hot_table(wide, 20_000)
    small = wide.range(0, 4000, 2).select(F.col("id").alias("seller_id"), (F.col("id") * 10).alias("tag"))
    small = small.union(wide.createDataFrame([(7, -1), (None, -2)], "seller_id long, tag long"))
    got = skew.skew_join(table, small, ["seller_id"], how)
    plain = table.join(small, ["seller_id"], how)
    assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
