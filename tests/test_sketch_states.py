"""Stored sketch states against exact values, within the stated bounds."""

import bisect

from pyspark.sql import functions as F

from tallymart.catalog.queries import AS_OF, START
from tallymart.functions.arrays import hist_median
from tallymart.plans import category, sketches
from tallymart.sources import sample

FOLDER = "/root/testdata/sf0.01"


def test_bounds_hold_on_many_values(spark):
    values = spark.range(200_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    row = values.agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("v", sketches.LG_K)).alias("n"),
        F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint("v", sketches.KLL_K), F.lit(0.5)).alias("median"),
    ).first()
    exact = sorted(r["v"] for r in values.collect())
    assert abs(row["n"] - 200_000) <= sketches.COUNT_ERROR * 200_000
    assert abs(bisect.bisect_left(exact, row["median"]) / len(exact) - 0.5) <= sketches.RANK_ERROR


def test_estimates_match_exact_values(spark):
    market = sample.stored_market(spark, FOLDER)
    states = sketches.category_day_states(market)
    near = {r["category_id"]: r for r in sketches.range_estimates(market, states, START, AS_OF).collect()}
    skus = market.sku_days(["purchase_price", "seller_link"], START, AS_OF)
    exact = {r["root_id"]: r for r in category.distinct_counts(market, skus, []).collect()}
    assert near and set(near) <= set(exact)
    prices = (
        category.in_subtree(market, skus.select("category_id", F.floor(hist_median(F.col("price_hist"))).cast("bigint").alias("p")))
        .groupBy("root_id").agg(F.sort_array(F.collect_list("p")).alias("ps")).collect()
    )
    medians = {r["root_id"]: [p for p in r["ps"] if p is not None] for r in prices}
    for root, row in near.items():
        for name in ("seller_count", "product_count"):
            assert abs(row[name] - exact[root][name]) <= max(1, sketches.COUNT_ERROR * exact[root][name])
        values = medians[root]
        if values:
            at = round(row["median_price"] * 100)
            low, high = bisect.bisect_left(values, at), bisect.bisect_right(values, at)
            rank = min(max(0.5, low / len(values)), high / len(values))
            assert abs(rank - 0.5) <= sketches.RANK_ERROR + 1 / len(values)
