"""Period snapshots: every top category and every period in one pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.arrays import hist_median, last_value
from tallymart.functions.numbers import trunc_decimal
from tallymart.functions.periods import PERIOD_DAYS
from tallymart.marketplace import Marketplace
from tallymart.operators.counters import with_orders
from tallymart.operators.spread import grouped_median
from tallymart.plans.category import adhoc_columns, price_levels, zeros
from tallymart.plans.rollup import merge_product_days, product_days, with_median
from tallymart.sources.stores import stage

PERIODS = tuple(PERIOD_DAYS.values())
HALF = ["period", "which", "root_id"]


def _halves(as_of: dt.date, periods: Sequence[int]) -> Column:
    """Current and previous window of every period; both bounds are shared days."""
    windows = []
    for days in periods:
        middle = as_of - dt.timedelta(days=days)
        far = as_of - dt.timedelta(days=2 * days)
        for which, start, end in (("current", middle, as_of), ("previous", far, middle)):
            windows.append(
                F.struct(
                    F.lit(days).alias("period"),
                    F.lit(which).alias("which"),
                    F.lit(start).alias("start"),
                    F.lit(end).alias("end"),
                )
            )
    return F.array(*windows)


def in_halves(
    rows: DataFrame, as_of: dt.date, periods: Sequence[int], at_midnight: Column
) -> DataFrame:
    """Repeat rows for each window that holds them.

    A window ends at the midnight that starts its last day: of that day only
    rows ``at_midnight`` belong to it, and those belong to the next window too.
    """
    date = F.col("date")
    fits = F.filter(
        _halves(as_of, periods),
        lambda w: (date >= w["start"])
        & ((date < w["end"]) | ((date == w["end"]) & at_midnight)),
    )
    return rows.withColumn("_window", F.explode(fits)).select(
        "*", F.col("_window.period").alias("period"), F.col("_window.which").alias("which")
    ).drop("_window")


def period_counts(
    market: Marketplace,
    as_of: dt.date,
    periods: Sequence[int] = PERIODS,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Distinct sellers and products per period, half and root, by whole days."""
    horizon = as_of - dt.timedelta(days=2 * max(periods))
    seen = market.sku_days([], horizon, as_of).select(
        "date", "category_id", "seller_id", "product_id"
    )
    halves = in_halves(seen, as_of, periods, F.lit(True))
    rows = halves.select("period", "which", "category_id", "seller_id", "product_id")
    return (
        rows.distinct()
        .join(market.subtree if pairs is None else pairs, "category_id")
        .groupBy(*HALF)
        .agg(
            F.count_distinct("seller_id").alias("seller_count"),
            F.count_distinct("product_id").alias("product_count"),
        )
    )


def _raw_days(market: Marketplace, as_of: dt.date, periods: Sequence[int]) -> DataFrame:
    """Product-day states per window and top category from raw snapshots."""
    horizon = as_of - dt.timedelta(days=2 * max(periods))
    date = F.to_date("timestamp")
    raw = market.snapshots(horizon, as_of).where(
        F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz")
    )
    collapsed = raw.groupBy(
        "product_id",
        date.alias("date"),
        (F.col("timestamp") == date.cast("timestamp_ntz")).alias("at_midnight"),
        F.col("latest_category_id").alias("category_id"),
        F.col("purchase_price").alias("price"),
    ).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("total_orders_amount").alias("low"),
        F.max("total_orders_amount").alias("high"),
        F.min("total_available_amount").alias("stock"),
        F.max("timestamp").alias("last_seen"),
    )
    alone = F.count(F.lit(1)).over(Window.partitionBy("product_id", "date")) == 1
    by_category = (
        collapsed.repartition("product_id")
        .groupBy("product_id", "date", "at_midnight", "category_id")
        .agg(
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.min("stock").alias("stock"),
            F.collect_list(F.struct("price", "cnt")).alias("price_hist"),
            F.max("last_seen").alias("last_seen"),
        )
        .transform(with_median, alone)
        .join(market.top_subtree, "category_id")
        .withColumn(
            "last_category_id", F.struct("last_seen", F.col("category_id").alias("value"))
        )
    )
    halves = in_halves(by_category, as_of, periods, F.col("at_midnight"))
    return with_orders(merge_product_days(halves, HALF), *HALF)


def category_period_stats(
    market: Marketplace, as_of: dt.date, periods: Sequence[int] = PERIODS
) -> DataFrame:
    """Figures of every category for each period and the one before it.

    A category missing in either half is left out. Sellers and products are
    those of its whole top category. Amounts are stored cut, not rounded.
    """
    keys = [*HALF, "category_id"]
    days = _raw_days(market, as_of, periods).withColumn(
        "category_id", F.col("last_category_id.value")
    )
    levels = stage(price_levels(days, keys), "period-levels")
    sums = levels.groupBy(*keys).agg(
        F.sum("orders").alias("order_amount"),
        F.sum("stock").alias("available_amount"),
        F.sum("minor").alias("revenue"),
    )
    medians = grouped_median(levels, keys, "median", "median_price", F.col("n"))
    counts = period_counts(market, as_of, periods, market.top_subtree)
    wide = (
        sums.join(medians, keys, "left")
        .join(counts, HALF, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("seller_count", "product_count")})
    )
    figures = [
        ("order_amount", "bigint"),
        ("available_amount", "bigint"),
        ("revenue", "bigint"),
        ("median_price", 2),
        ("avg_bill", 2),
        ("seller_count", "bigint"),
        ("product_count", "bigint"),
        ("order_per_product", 2),
        ("order_per_seller", 2),
        ("revenue_per_product", 2),
    ]
    named = wide.select(*keys, *adhoc_columns())

    def stored(column: str, kind: str | int) -> Column:
        value = F.col(column)
        return (
            value.cast(kind)
            if isinstance(kind, str)
            else trunc_decimal(value, kind).cast("decimal(18,2)")
        ).alias(column)

    cut = named.select(*keys, *(stored(c, kind) for c, kind in figures))

    def of(which: str, prefix: str) -> list[Column]:
        return [
            F.max(F.when(F.col("which") == which, F.col(c))).alias(prefix + c)
            for c, _ in figures
        ]

    return (
        cut.groupBy("period", "root_id", "category_id")
        .agg(
            F.count(F.lit(1)).alias("_halves"),
            *of("current", ""),
            *of("previous", "prev_"),
        )
        .where(F.col("_halves") == 2)
        .drop("_halves")
        .withColumn("snapshot_date", F.lit(as_of))
    )


def category_product_period_stats(
    market: Marketplace, as_of: dt.date, periods: Sequence[int] = PERIODS
) -> DataFrame:
    """Counter range, median price and last values per category x product.

    Counter bounds are those of the daily maxima; prices are cut to whole minor
    units per SKU-day first. ``median_hist``, ``last_seen`` and ``last_sku`` let
    snapshots of several categories merge exactly.
    """
    horizon = as_of - dt.timedelta(days=max(periods))
    attributes = ["purchase_price", "title", "photo_key", "reviews_amount"]
    skus = market.sku_days(attributes, horizon, as_of).join(market.top_subtree, "category_id")
    cut = F.floor(hist_median(F.col("price_hist"))).cast("bigint")
    order = (F.col("last_seen"), F.col("sku_id"))
    lasts = ("title", "photo_key", "reviews_amount", "rating")
    daily = skus.groupBy("root_id", "category_id", "product_id", "date").agg(
        F.min("high").alias("min_high"),
        F.max("high").alias("max_high"),
        F.collect_list(
            F.struct(cut.alias("price"), F.lit(1).cast("bigint").alias("cnt"))
        ).alias("median_hist"),
        F.sum("stock_low").alias("_stock"),
        *(last_value(F.col(c), *order).alias(c) for c in lasts),
        F.max(F.struct(*order)).alias("_at"),
    )
    stock = (
        daily.groupBy("root_id", "product_id", "date")
        .agg(
            F.sum("_stock").alias("available_amount"),
            F.collect_list(F.struct(*[c for c in daily.columns if c not in _DAY])).alias("_rows"),
        )
        .select("root_id", "product_id", "date", "available_amount", F.inline("_rows"))
    )
    fits = F.filter(
        F.array(*(F.lit(p) for p in periods)),
        lambda p: F.col("date") >= F.date_sub(F.lit(as_of), p),
    )
    at = (F.col("_at"),)
    return (
        stock.withColumn("period", F.explode(fits))
        .groupBy("period", "root_id", "category_id", "product_id")
        .agg(
            last_value(F.col("title"), *at).alias("title"),
            F.max("max_high").alias("max_total_order_amount"),
            F.min("min_high").alias("min_total_order_amount"),
            F.flatten(F.collect_list("median_hist")).alias("median_hist"),
            last_value(F.col("available_amount"), *at).alias("available_amount"),
            last_value(F.col("reviews_amount"), *at).alias("reviews_amount"),
            last_value(F.col("photo_key"), *at).alias("photo_key"),
            last_value(F.col("rating"), *at).alias("rating"),
            F.max("_at").alias("_at"),
        )
        .withColumns(
            {
                "median_price": hist_median(F.col("median_hist")),
                "last_seen": F.col("_at.last_seen"),
                "last_sku": F.col("_at.sku_id"),
                "snapshot_date": F.lit(as_of),
            }
        )
        .drop("_at")
    )


_DAY = ("root_id", "product_id", "date")


def category_daily_stats(
    market: Marketplace, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Unclamped orders, medians and distinct counts per category and day."""
    skus = market.sku_days(["purchase_price"], start, end)
    days = with_orders(with_median(product_days(skus, [])), clamp=False).select(
        F.col("last_category_id.value").alias("category_id"),
        "date",
        F.col("last_seller_id.value").alias("seller_id"),
        (F.col("orders") > 0).alias("sold"),
        "orders",
        "stock",
        "median",
    )
    keys = ["category_id", "date"]
    levels = stage(price_levels(days, [*keys, "seller_id", "sold"]), "daily-levels")
    sums = (
        levels.groupBy(*keys, "seller_id")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("stock").alias("stock"),
            F.sum("minor").alias("minor"),
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("sold"), F.col("n"))).alias("n_sold"),
        )
        .groupBy(*keys)
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("stock").alias("available_amount"),
            F.sum("minor").alias("revenue"),
            F.count("seller_id").alias("seller_count"),
            F.sum("n").alias("product_count"),
            F.count("n_sold").alias("seller_with_sales"),
            F.sum("n_sold").alias("product_with_sales"),
        )
    )
    weight = F.col("n")
    every = grouped_median(levels, keys, "median", "median_price_all", weight)
    sold = grouped_median(
        levels.where("sold"), keys, "median", "median_price_with_sales", weight
    )
    return (
        sums.join(every, keys, "left")
        .join(sold, keys, "left")
        .select(
            *keys,
            "orders",
            "available_amount",
            "median_price_all",
            "median_price_with_sales",
            "revenue",
            "seller_count",
            "product_count",
            "seller_with_sales",
            *zeros("product_with_sales"),
        )
    )
