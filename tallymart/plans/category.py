"""Category questions answered from the roll-up and the raw snapshots.

Every function covers all categories in one job; ``roots`` narrows it to some.
A category stands for its strict descendants, or for itself if it is a leaf.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.arrays import hist_median, last_value, ordered_array
from tallymart.functions.numbers import pct_diff, pct_diff_count, ratio, ratio_if
from tallymart.functions.periods import PERIOD_DAYS
from tallymart.marketplace import Marketplace
from tallymart.operators.counters import with_orders
from tallymart.operators.gaps import fill_array
from tallymart.operators.hierarchy import hierarchy
from tallymart.operators.shaping import SortBy, dynamic_filter, page, ranked, sort_columns, staged_with_total
from tallymart.operators.spread import grouped_median
from tallymart.plans.rollup import merge_product_days, product_days, with_median
from tallymart.plans.sales import product_sales
from tallymart.sources.stores import latest, stage

PRICE = ["purchase_price"]
SCOPE = ["scope_id", "shared"]

# Names a ranking of categories may be sorted by.
RANKING_FIELDS = {
    "order_amount": "order_amount",
    "revenue": "revenue",
    "average_bill": "avg_bill",
    "seller_count": "seller_count",
    "product_count": "product_count",
    "order_per_product": "order_per_product",
    "order_per_seller": "order_per_seller",
    "revenue_per_product": "revenue_per_product",
}


def in_subtree(
    market: Marketplace, rows: DataFrame, roots: Sequence[int] | None = None
) -> DataFrame:
    """Attach every ``root_id`` whose subtree holds the row's ``category_id``."""
    pairs = market.subtree
    if roots is not None:
        pairs = pairs.where(F.col("root_id").isin(list(roots)))
    return rows.join(pairs, "category_id")


def _member(market: Marketplace, roots: Sequence[int], rows: DataFrame) -> DataFrame:
    """Rows whose category lies in the subtree of any of ``roots``."""
    wanted = market.subtree.where(F.col("root_id").isin(list(roots))).select("category_id")
    return rows.join(wanted, "category_id", "left_semi")


def _roots_of(market: Marketplace, roots: Sequence[int] | None) -> DataFrame:
    """(category_id, roots), narrowed to some roots."""
    if roots is None:
        return market.roots_of
    wanted = F.filter("roots", lambda root: root.isin(list(roots)))
    return market.roots_of.select("category_id", wanted.alias("roots")).where(F.size("roots") > 0)


def category_days(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    attributes: Sequence[str] = PRICE,
    roots: Sequence[int] | None = None,
) -> DataFrame:
    """Product-day states with ``orders`` and ``median``; filtered before the lag.

    A product seen in a single category has the same days under each of its
    roots. It stays one row per day under that category, ``shared``, until
    ``to_roots`` spreads the aggregates. Only products that moved are repeated
    per root, where different days remain.
    """
    member = None if roots is None else partial(_member, market, roots)
    skus = market.sku_days(list(attributes), start, end, member)
    placed = product_days(skus, ["category_id"]).join(_roots_of(market, roots), "category_id")
    product = Window.partitionBy("product_id")
    moved = F.min("category_id").over(product) != F.max("category_id").over(product)

    def scope(number: Column, shared: bool) -> Column:
        return F.struct(number.alias("scope_id"), F.lit(shared).alias("shared"))

    scopes = F.when(
        F.col("moved"), F.transform("roots", lambda root: scope(root, False))
    ).otherwise(F.array(scope(F.col("category_id"), True)))
    wide = (
        placed.withColumn("moved", moved)
        .transform(with_median, ~F.col("moved"))
        .select("*", F.inline(scopes))
        .drop("roots", "moved")
    )
    return with_orders(merge_product_days(wide, SCOPE), *SCOPE)


def to_roots(
    market: Marketplace, rows: DataFrame, roots: Sequence[int] | None = None
) -> DataFrame:
    """Turn the scope of aggregated rows into ``root_id``, spreading shared ones."""
    above = _roots_of(market, roots).withColumnRenamed("category_id", "scope_id")
    targets = F.when(F.col("shared"), F.col("roots")).otherwise(F.array("scope_id"))
    spread = rows.join(above, "scope_id", "left").withColumn("root_id", F.explode(targets))
    return spread.drop("roots", *SCOPE)


def distinct_counts(
    market: Marketplace,
    rows: DataFrame,
    keys: list[str],
    roots: Sequence[int] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Distinct sellers and products per root over roll-up rows, exact by default."""
    pairs = rows.select(*keys, "category_id", "seller_id", "product_id").distinct()
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        in_subtree(market, pairs, roots)
        .groupBy(*keys, "root_id")
        .agg(
            count("seller_id").alias("seller_count"),
            count("product_id").alias("product_count"),
        )
    )


def _all_roots(market: Marketplace, roots: Sequence[int] | None) -> DataFrame:
    every = market.categories.select(F.col("category_id").alias("root_id"))
    return every if roots is None else every.where(F.col("root_id").isin(list(roots)))


def zeros(*columns: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns]


def category_daily_analytics(
    market: Marketplace, start: dt.date, end: dt.date, roots: Sequence[int] | None = None
) -> DataFrame:
    """Orders, stock, revenue and average bill of each category and day."""
    days = category_days(market, start, end, roots=roots)
    sums = days.groupBy(*SCOPE, "date").agg(
        F.sum("orders").alias("orders"),
        F.sum("stock").alias("stock"),
        F.sum(F.col("orders") * F.col("median")).alias("minor"),
    )
    daily = (
        to_roots(market, sums, roots)
        .groupBy("root_id", "date")
        .agg(
            F.sum("orders").alias("order_amount"),
            F.sum("stock").alias("available_amount"),
            F.greatest(F.sum("minor"), F.lit(0.0)).alias("_minor"),
        )
    )
    revenue = F.col("_minor") / 100
    return daily.select(
        F.col("root_id").alias("category_id"),
        "date",
        "order_amount",
        F.round(ratio_if(F.col("order_amount") > 0, revenue, F.col("order_amount")), 2).alias(
            "average_bill"
        ),
        "available_amount",
        F.round(revenue, 2).alias("revenue"),
    )


def category_analytics_adhoc(
    market: Marketplace, start: dt.date, end: dt.date, roots: Sequence[int] | None = None
) -> DataFrame:
    """One row per category over a date range, prices in minor units."""
    days = category_days(market, start, end, roots=roots)
    by_root = to_roots(market, price_levels(days, SCOPE), roots)
    levels = stage(merge_levels(by_root, ["root_id"]), "category-levels")
    sums = levels.groupBy("root_id").agg(
        F.sum("orders").alias("order_amount"),
        F.sum("stock").alias("available_amount"),
        F.sum("minor").alias("revenue"),
    )
    medians = grouped_median(levels, ["root_id"], "median", "median_price", F.col("n"))
    member = None if roots is None else partial(_member, market, roots)
    counts = distinct_counts(market, market.sku_days([], start, end, member), [], roots)
    joined = (
        _all_roots(market, roots)
        .join(sums, "root_id", "left")
        .join(medians, "root_id", "left")
        .join(counts, "root_id", "left")
        .select(
            "root_id",
            "median_price",
            *zeros(
                "order_amount", "available_amount", "revenue", "seller_count", "product_count"
            ),
        )
    )
    return joined.select(F.col("root_id").alias("category_id"), *adhoc_columns())


def adhoc_columns() -> list[Column]:
    """The eleven figures of a category over a period."""
    orders, revenue = F.col("order_amount"), F.col("revenue")
    sellers, products = F.col("seller_count"), F.col("product_count")
    sold = orders > 0
    return [
        orders,
        F.col("available_amount"),
        revenue,
        F.when(sold, F.col("median_price")).otherwise(F.lit(0.0)).alias("median_price"),
        ratio_if(sold, revenue, orders).alias("avg_bill"),
        sellers,
        products,
        ratio(orders, products).alias("order_per_product"),
        ratio(orders, sellers).alias("order_per_seller"),
        ratio_if(sold, revenue, products).alias("revenue_per_product"),
    ]


def price_levels(days: DataFrame, keys: list[str]) -> DataFrame:
    """Product-days counted per distinct daily median, with their sums.

    This is the only wide aggregation: sums and the median of a category both
    follow from it, so it is staged rather than computed twice.
    """
    return days.groupBy(*keys, "median").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("orders").alias("orders"),
        F.sum("stock").alias("stock"),
        F.sum(F.col("orders") * F.col("median")).alias("minor"),
    )


def merge_levels(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Add up price levels of several scopes."""
    return levels.groupBy(*keys, "median").agg(
        *(F.sum(c).alias(c) for c in ("n", "orders", "stock", "minor"))
    )


def category_analytics_with_prev(
    market: Marketplace,
    stats: DataFrame,
    counts: DataFrame,
    roots: Sequence[int] | None = None,
) -> DataFrame:
    """Current and previous period side by side, with percentage changes.

    ``stats`` holds category period snapshots, of which the newest is read;
    ``counts`` the distinct sellers and products per period, root and half.
    """
    sums = (
        in_subtree(market, latest(stats).drop("root_id"), roots)
        .groupBy("period", "root_id")
        .agg(
            F.sum("order_amount").alias("order_amount"),
            F.sum("available_amount").alias("available_amount"),
            (F.sum("revenue") / 100).alias("revenue"),
            F.sum("prev_order_amount").alias("prev_order_amount"),
            F.sum("prev_available_amount").alias("prev_available_amount"),
            (F.sum("prev_revenue") / 100).alias("prev_revenue"),
        )
    )

    def of(which: str, column: str) -> Column:
        return F.max(F.when(F.col("which") == which, F.col(column)))

    sided = counts.groupBy("period", "root_id").agg(
        of("current", "seller_count").alias("seller_count"),
        of("current", "product_count").alias("product_count"),
        of("previous", "seller_count").alias("prev_seller_count"),
        of("previous", "product_count").alias("prev_product_count"),
    )
    every = _all_roots(market, roots).withColumn(
        "period", F.explode(F.array(*(F.lit(p) for p in PERIOD_DAYS.values())))
    )
    keys = ["period", "root_id"]
    joined = every.join(sums, keys, "left").join(sided, keys, "left")
    both = [
        f"{p}{c}"
        for p in ("", "prev_")
        for c in (
            "order_amount",
            "available_amount",
            "revenue",
            "seller_count",
            "product_count",
        )
    ]
    joined = joined.select(*keys, *zeros(*both))
    for p in ("", "prev_"):
        orders, revenue = F.col(f"{p}order_amount"), F.col(f"{p}revenue")
        products, sellers = F.col(f"{p}product_count"), F.col(f"{p}seller_count")
        sold = orders > 0
        joined = joined.withColumns(
            {
                f"{p}avg_bill": ratio_if(sold, revenue, orders),
                f"{p}order_per_product": ratio_if(sold, orders, products),
                f"{p}order_per_seller": ratio_if(sold, orders, sellers),
                f"{p}revenue_per_product": ratio_if(sold, revenue, products),
            }
        )
    return joined.select(
        "period",
        F.col("root_id").alias("category_id"),
        *(F.col(c) for c in both),
        *(
            F.round(F.col(f"{p}{c}"), 2).alias(f"{p}{c}")
            for p in ("", "prev_")
            for c in (
                "avg_bill",
                "order_per_product",
                "order_per_seller",
                "revenue_per_product",
            )
        ),
        *(
            pct_diff(F.col(f"prev_{c}"), F.col(c)).alias(f"{c}_pct")
            for c in (
                "revenue",
                "revenue_per_product",
                "avg_bill",
                "order_per_seller",
                "order_per_product",
            )
        ),
        *(
            pct_diff_count(F.col(f"prev_{c}"), F.col(c)).alias(f"{c}_pct")
            for c in ("order_amount", "product_count", "seller_count")
        ),
    )


def category_children_ranking(
    market: Marketplace,
    analytics: DataFrame,
    sort: Sequence[SortBy] = (),
    parent_id: int | None = None,
) -> DataFrame:
    """Period figures of every child of ``parent_id`` (0: the top), sorted.

    Without ``parent_id`` the children of every category, parent by parent.
    """
    tree = hierarchy(market.categories)
    if parent_id is not None:
        tree = tree.where(F.col("parent_id") == parent_id)
    fields = []
    for one in sort:
        if one.field not in RANKING_FIELDS:
            raise ValueError(f"Unknown field name: {one.field}")
        fields.append(SortBy(RANKING_FIELDS[one.field], one.descending))
    ranked = tree.join(analytics, "category_id")
    return page(ranked, [SortBy("period"), SortBy("parent_id"), *fields], ["category_id"])


def products_order_chart(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    products: Sequence[int] | None = None,
    filled: bool = False,
    member: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Daily counter range per product as an array in date order.

    ``filled`` gives every product one entry per day of [start, end); otherwise
    the array holds the observed days, as callers have always received it.
    """
    skus = market.sku_days([], start, end, member)
    if products is not None:
        skus = skus.where(F.col("product_id").isin(list(products)))
    span = F.max("high") - F.min("low")
    days = skus.groupBy("product_id", "date").agg(span.alias("orders"))
    chart = (
        fill_array(start, end, F.col("date"), F.col("orders"), F.lit(0).cast("bigint"))
        if filled
        else ordered_array(F.col("date"), F.col("orders"))
    )
    return days.groupBy("product_id").agg(chart.alias("order_amount_chart"))


def category_products_analytics(
    market: Marketplace,
    stats: DataFrame,
    start: dt.date,
    end: dt.date,
    filters: Sequence = (),
    sort: Sequence[SortBy] = (),
    limit: int | None = None,
    offset: int = 0,
    roots: Sequence[int] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Products of each category from the newest product snapshot, with a chart.

    ``stats`` holds one period of category x product snapshots. The filters act
    on the aggregated columns; the total counts what they leave. ``position``
    names an added column with each row's rank in the whole sorted table; the
    page is then found by distributed rank selection and returned in its order.
    """
    at = (F.col("last_seen"), F.col("last_sku"))
    lasts = ("title", "available_amount", "reviews_amount", "photo_key", "rating")
    merged = (
        in_subtree(market, latest(stats).drop("root_id"), roots)
        .groupBy("root_id", "product_id")
        .agg(
            (F.max("max_total_order_amount") - F.min("min_total_order_amount")).alias(
                "order_amount"
            ),
            F.flatten(F.collect_list("median_hist")).alias("_hist"),
            *(last_value(F.col(c), *at).alias(c) for c in lasts),
        )
    )
    price = hist_median(F.col("_hist")) / 100
    rows = merged.select(
        F.col("root_id").alias("category_id"),
        "product_id",
        "title",
        "order_amount",
        price.alias("price"),
        (price * F.col("order_amount")).alias("revenue"),
        "available_amount",
        "reviews_amount",
        "photo_key",
        F.round("rating", 1).alias("rating"),
    )
    kept = dynamic_filter(rows, filters)
    counted = staged_with_total(kept, ["category_id"], "total_row_count")
    if position is not None:
        counted = ranked(counted, sort, ["category_id", "product_id"], limit, offset, position)
    elif limit is not None or sort or offset:
        counted = page(counted, sort, ["category_id", "product_id"], limit, offset)
    shown = None
    if limit is not None:
        counted = stage(counted, "page")
        shown = partial(_shown, counted)
    chart = products_order_chart(market, start, end, member=shown)
    joined = counted.join(chart, "product_id", "left")
    if position is not None:
        return joined.orderBy(position)
    if limit is None:
        return joined
    # A join keeps no order; a page is small enough to be sorted again.
    return joined.orderBy(*sort_columns(joined, sort, ["category_id", "product_id"]))


def _shown(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the products of one page."""
    return rows.join(table.select("product_id"), "product_id", "left_semi")


def category_overall_info(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    roots: Sequence[int] | None = None,
) -> DataFrame:
    """Sales, averages and zero-sales counts of each category from raw snapshots.

    Timestamps run from midnight of ``start`` to midnight of ``end``, included.
    """
    raw = market.snapshots(start, end).where(
        F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")
    )
    if roots is not None:
        named = raw.withColumn("category_id", F.col("latest_category_id"))
        raw = _member(market, roots, named).drop("category_id")
    seen = raw.groupBy(
        F.col("latest_category_id").alias("category_id"),
        "product_id",
        "seller_id",
        F.col("purchase_price").alias("price"),
    ).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("total_orders_amount").alias("low"),
        F.max("total_orders_amount").alias("high"),
    )
    by_product = seen.groupBy("category_id", "product_id").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.collect_list(F.struct("price", "cnt")).alias("price_hist"),
        F.collect_set("seller_id").alias("sellers"),
    )
    products = (
        in_subtree(market, by_product, roots)
        .groupBy("root_id", "product_id")
        .agg(
            (F.max("high") - F.min("low")).alias("orders"),
            hist_median(F.flatten(F.collect_list("price_hist"))).alias("price"),
            F.array_distinct(F.flatten(F.collect_list("sellers"))).alias("sellers"),
        )
    )
    staged = stage(products, "category-products")
    sold = F.col("orders") > 0
    totals = staged.groupBy("root_id").agg(
        F.count_if(sold).alias("sold"),
        F.sum(F.when(sold, F.col("price"))).alias("price_sum"),
        F.sum(F.when(sold, F.col("orders") * F.col("price"))).alias("minor"),
        F.sum(F.when(sold, F.col("orders"))).alias("order_count"),
        F.count(F.lit(1)).alias("product_counts"),
        F.count_if(~sold).alias("product_zero_sales_count"),
    )
    zero_sellers = (
        staged.groupBy("root_id", F.array_max("sellers").alias("seller_id"))
        .agg(F.sum("orders").alias("orders"))
        .groupBy("root_id")
        .agg(F.count_if(F.col("orders") <= 0).alias("seller_with_zero_sales_count"))
    )
    sellers = (
        staged.select("root_id", F.explode("sellers").alias("seller_id"))
        .groupBy("root_id")
        .agg(F.count_distinct("seller_id").alias("seller_counts"))
    )
    joined = totals.join(zero_sellers, "root_id").join(sellers, "root_id")
    orders = F.coalesce("order_count", F.lit(0))
    return joined.select(
        F.col("root_id").alias("category_id"),
        F.round(ratio(F.col("price_sum") / 100, F.col("sold")), 2).alias("avg_price"),
        F.coalesce(F.col("minor") / 100, F.lit(0.0)).alias("revenue"),
        orders.alias("order_count"),
        "seller_counts",
        "product_counts",
        F.round(ratio(orders, F.col("seller_counts")), 3).alias("sales_per_seller"),
        "seller_with_zero_sales_count",
        "product_zero_sales_count",
    )


def category_sales_report(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    roots: Sequence[int] | None = None,
    limit: int | None = None,
    offset: int = 0,
    total: bool = True,
) -> DataFrame:
    """Sales report of the products of each category, with their number if asked."""
    attributes = ["purchase_price", "title", "seller_title"]
    days = category_days(market, start, end, attributes, roots)
    spread = to_roots(market, product_sales(market, days, SCOPE), roots)
    report = spread.withColumnRenamed("root_id", "category_id")
    if total:
        report = staged_with_total(report, ["category_id"])
    if limit is None and not offset:
        return report
    return page(report, (), ["category_id", "product_id"], limit, offset)
