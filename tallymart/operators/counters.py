"""Daily orders and stock movement from irregularly observed counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(column: str, *scope: str) -> Column:
    """Value of the previous observed day within ``scope``; 0 on the first."""
    return F.lag(column, 1, 0).over(Window.partitionBy(*scope).orderBy("date"))


def order_delta(low: Column, high: Column, before: Column, clamp: bool = True) -> Column:
    """Orders of a day from its counter range and the previous day's maximum.

    Without an earlier day the range itself counts, otherwise everything since
    the earlier maximum. A counter that fell gives 0 when clamped.
    """
    change = F.when(before > 0, high - before).otherwise(high - low)
    return F.greatest(change, F.lit(0).cast("bigint")) if clamp else change


def with_orders(days: DataFrame, *scope: str, clamp: bool = True) -> DataFrame:
    """Add ``orders`` to rows that hold one ``scope`` x product x date each.

    The window must see rows that already passed every filter: an unobserved
    or filtered day is skipped, not counted as zero.
    """
    keys = [*scope, "product_id"]
    return days.withColumn("_before", previous("high", *keys)).withColumn(
        "orders", order_delta(F.col("low"), F.col("high"), F.col("_before"), clamp)
    ).drop("_before")


def stock_delta(low: Column, high: Column, before: Column) -> Column:
    """Units that left the stock during a day.

    A maximum above the last seen level is a refill and counts nothing; a flat
    day below it counts the drop since then; otherwise the day's own range.
    """
    span = high - low
    return (
        F.when(high > before, F.lit(0).cast("bigint"))
        .when((span == 0) & (before > high), before - high)
        .otherwise(span)
    )


def stock_orders(restriction: Column, counter_span: Column, moved: Column) -> Column:
    """Orders of a SKU-day: the counter when sales are restricted, else stock."""
    return F.when(restriction > 0, counter_span).otherwise(
        F.greatest(moved, F.lit(0).cast("bigint"))
    )
