"""The ABC report over a seller's or a category's products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.arrays import array_total, days_in_stock
from tallymart.operators.abc import abc_classify
from tallymart.sources.stores import stage

# Report columns in file order.
COLUMNS = [
    "seller_title",
    "product_id",
    "name",
    "category_name",
    "available_amounts",
    "days_in_stock",
    "purchase_price",
    "order_amount",
    "revenue",
    "abc_orders",
    "abc_revenue",
]


def abc_report(sales: DataFrame, scope: list[str]) -> DataFrame:
    """Eleven columns per product of a sales report, classified within ``scope``.

    The report is read for its rows and again for the ranking, so it is staged.
    """
    rows = sales.select(
        *scope,
        "seller_title",
        "product_id",
        "name",
        "category_name",
        "available_amounts",
        days_in_stock(F.col("available_amount_graph")).alias("days_in_stock"),
        "purchase_price",
        array_total(F.col("order_graph")).alias("order_amount"),
        F.round("sales", 2).cast("decimal(20,2)").alias("revenue"),
    )
    staged = stage(rows, "abc-report")
    classes = {"order_amount": "abc_orders", "revenue": "abc_revenue"}
    both = abc_classify(staged, scope, classes)
    return both.select(*dict.fromkeys([*scope, *COLUMNS]))


def export_report(report: DataFrame, path: str, scope: list[str]) -> None:
    """Write a report as CSV with a header, one folder per seller or category."""
    report.write.mode("overwrite").partitionBy(*scope).option("header", True).csv(path)
