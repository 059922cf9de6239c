"""The daily roll-up as mergeable rows, and the views that merge them.

Raw snapshots collapse to *observations*: one row per SKU, day and combination
of slowly changing texts and prices, holding minima, maxima and a count. Texts
and prices are grouping keys, so every state is a fixed-width number: the
aggregation hashes in generated code, combines before the shuffle, and the
count per price is an exact histogram. Observations of any two batches merge by
aggregating again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.arrays import hist_median, last_value

SKU_DAY = ["date", "product_id", "sku_id"]
ATTRIBUTES = [
    "title",
    "photo_key",
    "reviews_amount",
    "seller_title",
    "seller_link",
    "full_price",
    "purchase_price",
]
MAXIMA = [
    "category_id",
    "seller_id",
    "seller_account_id",
    "seller_registration_date",
    "rating",
    "is_eco",
    "is_adult",
]


def _states(columns: list[str]):
    """Aggregates that merge observations; also used to build them."""
    merge = {"seen": F.sum, "low": F.min, "stock_low": F.min}
    return [merge.get(c, F.max)(c).alias(c) for c in columns]


STATES = ["seen", "last_seen", "low", "high", "stock_low", "stock_high", *MAXIMA]


def observations(snapshots: DataFrame) -> DataFrame:
    """Collapse raw snapshots to mergeable rows."""
    renamed = snapshots.select(
        F.to_date("timestamp").alias("date"),
        "product_id",
        "sku_id",
        *ATTRIBUTES,
        F.lit(1).cast("bigint").alias("seen"),
        F.col("timestamp").alias("last_seen"),
        F.col("total_orders_amount").alias("low"),
        F.col("total_orders_amount").alias("high"),
        F.col("available_amount").alias("stock_low"),
        F.col("available_amount").alias("stock_high"),
        F.col("latest_category_id").alias("category_id"),
        *MAXIMA[1:],
    )
    return renamed.groupBy(*SKU_DAY, *ATTRIBUTES).agg(*_states(STATES))


def merge(partials: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Merge partial observations, keeping only the attributes a reader needs."""
    keys = ATTRIBUTES if attributes is None else attributes
    return partials.groupBy(*SKU_DAY, *keys).agg(*_states(STATES))


def _histogram(price: str):
    entry = F.struct(F.col(price).alias("price"), F.col("seen").alias("cnt"))
    return F.collect_list(F.when(F.col(price).isNotNull(), entry))


def sku_days(merged: DataFrame) -> DataFrame:
    """One row per SKU and day.

    The input is already collapsed, so a product has as many rows as distinct
    SKU-days and prices, not as many as it was scraped; partitioning by product
    is safe now, and serves every later grouping and window by product. A SKU
    is seen at most once per second, which bounds a day's histogram.
    """
    by_product = merged.repartition("product_id")
    known = set(merged.columns)
    lasts = [c for c in ("title", "photo_key", "reviews_amount") if c in known]
    maxima = [c for c in (*MAXIMA, "seller_title", "seller_link") if c in known]
    hists = {"purchase_price": "price_hist", "full_price": "full_hist"}
    return by_product.groupBy(*SKU_DAY).agg(
        *(last_value(F.col(c), F.col("last_seen")).alias(c) for c in lasts),
        *(F.max(c).alias(c) for c in maxima),
        *(_histogram(p).alias(h) for p, h in hists.items() if p in known),
        F.max("last_seen").alias("last_seen"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("stock_low").alias("stock_low"),
        F.max("stock_high").alias("stock_high"),
    )


def daily_sales(days: DataFrame) -> DataFrame:
    """The public shape of the roll-up: medians instead of histograms."""
    return days.select(
        *SKU_DAY,
        "title",
        "photo_key",
        "category_id",
        F.col("low").alias("min_total_order_amount"),
        F.col("high").alias("max_total_order_amount"),
        F.col("stock_low").alias("min_available_amount"),
        F.col("stock_high").alias("max_available_amount"),
        hist_median(F.col("full_hist")).alias("median_full_price"),
        hist_median(F.col("price_hist")).alias("median_price"),
        "seller_id",
        "seller_account_id",
        "seller_title",
        "seller_link",
        "seller_registration_date",
        "rating",
        "is_eco",
        "is_adult",
        "reviews_amount",
    )


_LASTS = ["title", "photo_key", "reviews_amount", "category_id", "seller_id", "seller_link"]
_JOINED = ["price_hist", "full_hist"]
_TOP = ["high", "seller_title", "rating", "last_seen"]


def product_days(days: DataFrame, scope: list[str]) -> DataFrame:
    """Group SKU-days to scope x product x date, as states that merge further.

    ``last_*`` columns are structs ordered by (last seen, SKU); histograms are
    arrays. Aggregates a query does not use are pruned by the optimizer.
    """
    known = set(days.columns)
    order = [F.col("last_seen").alias("at"), F.col("sku_id").alias("sku")]

    def last(column: str):
        value = F.col(column)
        return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("value"))))

    return days.groupBy(*scope, "product_id", "date").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("stock_low").alias("stock"),
        F.sum("stock_low").alias("stock_sum"),
        *(F.flatten(F.collect_list(c)).alias(c) for c in _JOINED if c in known),
        *(F.max(c).alias(c) for c in ("seller_title", "rating") if c in known),
        *(last(c).alias(f"last_{c}") for c in _LASTS if c in known),
    )


def with_median(days: DataFrame, final: Column | None = None) -> DataFrame:
    """Replace the price histogram by its ``median`` where that is final.

    Rows that may still merge with others are not ``final`` and keep their
    histogram; without the condition all rows are.
    """
    median = hist_median(F.col("price_hist"))
    if final is None:
        return days.withColumn("median", median).drop("price_hist")
    return (
        days.withColumn("_final", final)
        .withColumn("median", F.when(F.col("_final"), median))
        .withColumn("price_hist", F.when(~F.col("_final"), F.col("price_hist")))
        .drop("_final")
    )


def merge_product_days(days: DataFrame, scope: list[str]) -> DataFrame:
    """Merge product-day states of several categories into a wider scope.

    ``days`` come from ``with_median``; the result has a ``median`` throughout.
    """
    known = set(days.columns)
    tops = [c for c in days.columns if c in _TOP or c.startswith("last_")]
    merged = F.when(
        F.max("median").isNull(), hist_median(F.flatten(F.collect_list("price_hist")))
    ).otherwise(F.max("median"))
    return days.groupBy(*scope, "product_id", "date").agg(
        F.min("low").alias("low"),
        *(F.max(c).alias(c) for c in tops),
        *(F.min(c).alias(c) for c in ("stock",) if c in known),
        *(F.sum(c).alias(c) for c in ("stock_sum",) if c in known),
        merged.alias("median"),
    )
