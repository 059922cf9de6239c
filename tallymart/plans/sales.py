"""The per-product sales report shared by categories and sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.arrays import last_value
from tallymart.marketplace import Marketplace
from tallymart.operators.hierarchy import with_title


def product_sales(market: Marketplace, days: DataFrame, scope: list[str]) -> DataFrame:
    """Daily arrays, last values and revenue of every product in a scope.

    ``days`` are product-day states with ``orders`` and ``median``. A product has one row per
    day, which bounds its arrays by the calendar.
    """
    at = F.col("date")
    series = F.array_sort(
        F.collect_list(
            F.struct(
                "date",
                "orders",
                "stock",
                (F.col("median") / 100).alias("price"),
            )
        )
    )
    merged = days.groupBy(*scope, "product_id").agg(
        series.alias("_days"),
        last_value(F.col("seller_title"), at).alias("seller_title"),
        last_value(F.col("last_seller_id.value"), at).alias("seller_id"),
        last_value(F.col("last_category_id.value"), at).alias("latest_category_id"),
        last_value(F.col("last_title.value"), at).alias("name"),
        (F.sum(F.col("orders") * F.col("median")) / 100).alias("sales"),
    )
    last_day = F.element_at("_days", -1)
    report = merged.select(
        *scope,
        "product_id",
        "seller_title",
        "seller_id",
        "latest_category_id",
        F.col("_days.orders").alias("order_graph"),
        F.col("_days.stock").alias("available_amount_graph"),
        F.col("_days.price").alias("price_graph"),
        last_day["stock"].alias("available_amounts"),
        last_day["price"].alias("purchase_price"),
        "sales",
        "name",
    )
    return with_title(report, market.titles, "latest_category_id", "category_name")
