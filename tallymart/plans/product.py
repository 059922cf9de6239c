"""Product questions: history, sales, daily analytics and positions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.arrays import first_value, hist_median, last_value
from tallymart.functions.numbers import ratio
from tallymart.marketplace import Marketplace
from tallymart.operators.counters import previous, stock_delta, stock_orders, with_orders
from tallymart.operators.gaps import day_spine, gap_fill
from tallymart.operators.hierarchy import with_title
from tallymart.plans.rollup import product_days


def _only(rows: DataFrame, products: Sequence[int] | None) -> DataFrame:
    if products is None:
        return rows
    return rows.where(F.col("product_id").isin(list(products)))


def _histogram(price: str):
    return F.collect_list(F.struct(F.col(price).alias("price"), F.col("cnt").alias("cnt")))


def product_first_discovered(
    market: Marketplace, products: Sequence[int] | None = None
) -> DataFrame:
    """When each SKU was first seen, over all time."""
    return (
        _only(market.products, products)
        .groupBy("product_id", "sku_id")
        .agg(F.min("timestamp").alias("first_discovered"))
    )


def product_sku_history(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    products: Sequence[int] | None = None,
) -> DataFrame:
    """Orders of each SKU and day from stock depletion, or the counter if restricted."""
    keys = ["product_id", "sku_id", "date"]
    raw = _only(market.snapshots(start, end), products).where(
        F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")
    )
    collapsed = raw.groupBy(
        "product_id",
        "sku_id",
        F.to_date("timestamp").alias("date"),
        "title",
        "photo_key",
        "full_price",
        "purchase_price",
        "available_amount",
    ).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min("total_orders_amount").alias("counter_low"),
        F.max("total_orders_amount").alias("counter_high"),
        F.max("total_available_amount").alias("total_available_amount"),
        F.min("reviews_amount").alias("reviews_low"),
        F.max("reviews_amount").alias("reviews_high"),
        F.min("restriction").alias("restriction"),
    )
    seen = F.col("first_seen")
    days = (
        collapsed.repartition("product_id", "sku_id")
        .groupBy(*keys)
        .agg(
            first_value(F.col("title"), seen).alias("title"),
            first_value(F.col("full_price"), seen).alias("full_price"),
            first_value(F.col("photo_key"), seen).alias("photo_key"),
            last_value(F.col("available_amount"), F.col("last_seen")).alias("stock_last"),
            F.min("available_amount").alias("stock_low"),
            F.max("available_amount").alias("stock_high"),
            (F.max("counter_high") - F.min("counter_low")).alias("counter_span"),
            F.max("total_available_amount").alias("total_available_amount"),
            (F.max("reviews_high") - F.min("reviews_low")).alias("review_amount"),
            hist_median(_histogram("purchase_price")).alias("median"),
            F.min("restriction").alias("restriction"),
        )
        .withColumn("before", previous("stock_last", "product_id", "sku_id"))
    )
    moved = stock_delta(F.col("stock_low"), F.col("stock_high"), F.col("before"))
    orders = stock_orders(F.col("restriction"), F.col("counter_span"), moved)
    return days.withColumn("order_amount", orders).select(
        *keys,
        "title",
        "order_amount",
        "review_amount",
        (F.col("full_price") / 100).alias("full_price"),
        (F.col("median") / 100).alias("purchase_price"),
        "photo_key",
        (F.col("order_amount") * F.col("median") / 100).alias("sales_amount"),
        F.col("stock_last").alias("available_amount"),
        "total_available_amount",
    )


def products_sales(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    products: Sequence[int] | None = None,
) -> DataFrame:
    """Orders and sales of products over a range, from raw snapshots."""
    if end <= start:
        raise ValueError("the range must end after it starts")
    raw = _only(market.snapshots(start, end), products).where(
        F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")
    )
    collapsed = raw.groupBy(
        "product_id",
        "sku_id",
        F.to_date("timestamp").alias("date"),
        "title",
        "seller_title",
        "seller_link",
        "purchase_price",
    ).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("timestamp").alias("first_seen"),
        F.min("total_orders_amount").alias("low"),
        F.max("total_orders_amount").alias("high"),
        F.max("seller_account_id").alias("seller_account_id"),
    )
    days = (
        collapsed.repartition("product_id")
        .groupBy("product_id", "date")
        .agg(
            first_value(F.col("title"), F.col("first_seen"), F.col("sku_id")).alias("title"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            hist_median(_histogram("purchase_price")).alias("median"),
            F.max("seller_title").alias("seller_title"),
            F.max("seller_link").alias("seller_link"),
            F.max("seller_account_id").alias("seller_account_id"),
        )
    )
    at = F.col("date")
    return (
        with_orders(days)
        .groupBy("product_id")
        .agg(
            first_value(F.col("title"), at).alias("title"),
            F.sum("orders").alias("order_amount"),
            (F.sum(F.col("orders") * F.col("median")) / 100).alias("sales_amount"),
            first_value(F.col("seller_title"), at).alias("seller_title"),
            first_value(F.col("seller_link"), at).alias("seller_link"),
            first_value(F.col("seller_account_id"), at).alias("seller_account_id"),
            ratio(F.sum("orders"), F.lit((end - start).days)).alias("daily_order_amount"),
        )
    )


def product_daily_analytics(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    products: Sequence[int] | None = None,
) -> DataFrame:
    """One row per product with gap-filled daily charts.

    Days run from the first observed one up to, not including, ``end``; an
    unobserved day counts 0 in the charts, so the price is 0 if the last day is
    one. Texts and the full price carry on from the last observation. The stock
    chart has observed days only.
    """
    attributes = [
        "purchase_price",
        "full_price",
        "title",
        "photo_key",
        "reviews_amount",
        "seller_title",
        "seller_link",
    ]
    skus = _only(market.sku_days(attributes, start, end), products)
    days = with_orders(product_days(skus, [])).withColumns(
        {
            "price": hist_median(F.col("price_hist")),
            "full": hist_median(F.col("full_hist")),
        }
    )
    at = F.col("date")
    day = F.struct(
        "orders",
        "price",
        F.col("stock_sum").alias("stock"),
        F.col("last_reviews_amount.value").alias("reviews"),
        F.col("last_photo_key.value").alias("photo"),
        "rating",
    )
    merged = days.groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("date", day.alias("row")))).alias("series"),
        F.min("date").alias("first_day"),
        last_value(F.col("last_title.value"), at).alias("title"),
        last_value(F.col("last_category_id.value"), at).alias("category_id"),
        last_value(F.col("last_seller_link.value"), at).alias("seller_link"),
        last_value(F.col("seller_title"), at).alias("seller_title"),
        last_value(F.col("full"), at).alias("full_price"),
    )
    spine = F.array_sort(
        F.array_union(day_spine(F.col("first_day"), F.lit(end)), F.col("series.date"))
    )
    seen = F.map_from_entries("series")
    dense = merged.withColumns({"_seen": seen, "_days": spine}).withColumn(
        "_last", F.try_element_at("_seen", F.element_at("_days", -1))
    )

    def chart(value):
        return F.transform(
            "_days",
            lambda d: F.coalesce(value(F.try_element_at(F.col("_seen"), d)), F.lit(0)),
        )

    minor = F.aggregate(
        "series",
        F.lit(0.0),
        lambda acc, x: acc + x["row"]["orders"] * x["row"]["price"],
    )
    rows = dense.select(
        "product_id",
        "title",
        "category_id",
        "seller_link",
        "seller_title",
        F.round(F.coalesce(F.col("_last.price"), F.lit(0.0)), 2).alias("price"),
        F.round("full_price", 2).alias("full_price"),
        F.coalesce(F.col("_last.reviews"), F.lit(0)).alias("review_amount"),
        F.round(minor / 100, 2).alias("revenue_sum"),
        F.coalesce(F.col("_last.photo"), F.lit("")).alias("photo_key"),
        F.coalesce(F.col("_last.rating"), F.lit(0).cast("decimal(9,2)")).alias("rating"),
        chart(lambda r: r["price"] / 100).alias("price_chart"),
        chart(lambda r: r["orders"] * r["price"] / 100).alias("revenue_chart"),
        chart(lambda r: r["orders"]).alias("order_chart"),
        F.col("series.row.stock").alias("available_chart"),
    )
    titled = with_title(rows, market.titles, "category_id", "category_name", "unknown")
    return titled.join(first_days(market, products), "product_id", "left")


def first_days(market: Marketplace, products: Sequence[int] | None = None) -> DataFrame:
    """First day each product was seen, over all time."""
    if market.partials is None:
        source = market.products.select(
            "product_id", F.to_date("timestamp").alias("date")
        )
    else:
        source = market.partials.select("product_id", "date")
    return (
        _only(source, products)
        .groupBy("product_id")
        .agg(F.min("date").alias("first_discovered"))
    )


def product_position_history(
    positions: DataFrame,
    start: dt.date,
    end: dt.date,
    products: Sequence[int] | None = None,
) -> DataFrame:
    """Last position per SKU, category and day; 0 on days without one.

    The time range ends at the midnight that starts ``end``.
    """
    keys = ["category_id", "product_id", "sku_id"]
    midnight = F.col("timestamp").between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    )
    observed = (
        _only(positions, products)
        .where(midnight)
        .groupBy(*keys, F.to_date("timestamp").alias("date"), "position")
        .agg(F.max("timestamp").alias("at"))
        .groupBy(*keys, "date")
        .agg(last_value(F.col("position"), F.col("at")).alias("position"))
    )
    return gap_fill(observed, keys, start, end, {"position": 0})
