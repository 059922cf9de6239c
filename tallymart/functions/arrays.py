"""First/last values, date-ordered arrays and medians of price histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _keyed(value: Column, order: tuple[Column, ...]) -> Column:
    parts = [part.alias(f"k{i}") for i, part in enumerate(order)]
    return F.when(value.isNotNull(), F.struct(*parts, value.alias("value")))


def first_value(value: Column, *order: Column) -> Column:
    """Non-NULL value with the smallest order key; ties by the value itself."""
    return F.min(_keyed(value, order))["value"]


def last_value(value: Column, *order: Column) -> Column:
    """Non-NULL value with the greatest order key; ties by the value itself."""
    return F.max(_keyed(value, order))["value"]


def ordered_array(order: Column, value: Column) -> Column:
    """Aggregate ``value`` into an array sorted by ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda pair: pair["v"])


def days_in_stock(stock: Column) -> Column:
    """How many entries of a daily stock array are above zero."""
    return F.size(F.filter(stock, lambda amount: amount > 0))


def array_total(values: Column) -> Column:
    """Sum of an array of longs."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def hist_median(hist: Column) -> Column:
    """Interpolated median of ``array<struct<price,cnt>>``, as a double.

    Equal prices may occur in several entries, so histograms merge by plain
    concatenation. Most days see a single price and skip the walk.
    """
    total = F.aggregate(hist, F.lit(0).cast("bigint"), lambda acc, x: acc + x["cnt"])
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"),
        total.alias("total"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )

    def step(acc: Column, entry: Column) -> Column:
        upto = acc["seen"] + entry["cnt"]
        price = entry["price"].cast("double")
        low_rank = F.floor((acc["total"] - 1) / 2)
        high_rank = F.floor(acc["total"] / 2)
        return F.struct(
            upto.alias("seen"),
            acc["total"].alias("total"),
            F.coalesce(acc["low"], F.when(low_rank < upto, price)).alias("low"),
            F.coalesce(acc["high"], F.when(high_rank < upto, price)).alias("high"),
        )

    walked = F.aggregate(
        F.sort_array(hist), start, step, lambda acc: (acc["low"] + acc["high"]) / 2
    )
    return F.when(F.size(hist) == 1, hist[0]["price"].cast("double")).when(
        F.size(hist) > 1, walked
    )
