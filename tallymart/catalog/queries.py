"""Queries by name, each a function of the session and a folder of given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.catalog import streams
from tallymart.functions.arrays import (
    days_in_stock,
    first_value,
    hist_median,
    last_value,
    ordered_array,
)
from tallymart.functions.numbers import pct_diff, pct_diff_count, to_money, trunc_decimal
from tallymart.functions.periods import PERIOD_DAYS, period_range
from tallymart.operators import hierarchy as tree
from tallymart.operators.abc import abc_classify
from tallymart.operators.counters import with_orders
from tallymart.operators.gaps import gap_fill, gap_fill_carry
from tallymart.operators.shaping import Between, Contains, Equals, SortBy, dynamic_filter, page
from tallymart.operators.spread import grouped_median
from tallymart.plans import audits, category, product, report, rollup, seller, sketches, snapshots
from tallymart.session import fresh_folder
from tallymart.sources import sample, stores, upserts

START, AS_OF = sample.START, sample.AS_OF
Query = Callable[[SparkSession, str], DataFrame]


def as_text(values: str, exact: str = "decimal(20,3)") -> Column:
    """An array as comma-joined text, the same in every engine."""
    return F.array_join(
        F.transform(values, lambda x: x.cast(exact).cast("string")), ","
    ).alias(values)


def with_text(table: DataFrame, **arrays: str) -> DataFrame:
    return table.select(
        *(as_text(c, arrays[c]) if c in arrays else F.col(c) for c in table.columns)
    )


def _market_query(run: Callable[..., DataFrame], *args, **kwargs) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(sample.stored_market(spark, folder), *args, **kwargs)

    return query


# --- categories -----------------------------------------------------------


def category_descendants(spark, folder):
    return tree.descendants(sample.stored_market(spark, folder).closure)


def category_subtree(spark, folder):
    return sample.stored_market(spark, folder).subtree


def category_hierarchy(spark, folder):
    table = tree.hierarchy(sample.stored_market(spark, folder).categories)
    return with_text(table, children_ids="bigint")


def category_title(spark, folder):
    market = sample.stored_market(spark, folder)
    seen = market.products.select(
        "product_id", F.col("latest_category_id").alias("category_id")
    ).distinct()
    return tree.with_title(seen, market.titles, "category_id", "category_title", "unknown")


def category_period_stats(spark, folder):
    return snapshots.category_period_stats(sample.stored_market(spark, folder), AS_OF)


def category_product_period_stats(spark, folder):
    table = snapshots.category_product_period_stats(sample.stored_market(spark, folder), AS_OF)
    return table.drop("median_hist", "last_seen", "last_sku")


_SNAPSHOTS: dict[tuple[str, str], tuple[str, str]] = {}


def stored_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Category and product snapshots, written once per session as a job would."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SNAPSHOTS:
        market = sample.stored_market(spark, folder)
        paths = fresh_folder(spark, "category-stats"), fresh_folder(spark, "product-stats")
        stores.write_snapshot(snapshots.category_period_stats(market, AS_OF), paths[0])
        stores.write_snapshot(snapshots.category_product_period_stats(market, AS_OF), paths[1])
        _SNAPSHOTS[key] = paths
    by_category, by_product = _SNAPSHOTS[key]
    return spark.read.parquet(by_category), spark.read.parquet(by_product)


def category_analytics_with_prev(spark, folder):
    market = sample.stored_market(spark, folder)
    counts = snapshots.period_counts(market, AS_OF)
    stats, _ = stored_snapshots(spark, folder)
    return category.category_analytics_with_prev(market, stats, counts)


def category_children_ranking(spark, folder):
    market = sample.stored_market(spark, folder)
    ranked = category.category_children_ranking(
        market,
        category_analytics_with_prev(spark, folder),
        [SortBy("revenue", descending=True), SortBy("seller_count")],
    )
    return ranked.select(
        "period", "parent_id", "category_id", "name", "revenue", "order_amount", "revenue_pct"
    )


def category_products_analytics(spark, folder):
    _, stats = stored_snapshots(spark, folder)
    start, end = period_range(AS_OF, "month")
    table = category.category_products_analytics(
        sample.stored_market(spark, folder),
        stats.where(F.col("period") == PERIOD_DAYS["month"]),
        start,
        end,
        filters=[Between("order_amount", 1, 10**9)],
    )
    return with_text(table, order_amount_chart="bigint")


def category_products_page(spark, folder):
    """A page past the first of category products under some roots: filtered, sorted by two fields, with positions."""
    _, stats = stored_snapshots(spark, folder)
    start, end = period_range(AS_OF, "month")
    table = category.category_products_analytics(
        sample.stored_market(spark, folder),
        stats.where(F.col("period") == PERIOD_DAYS["month"]),
        start,
        end,
        filters=[Between("order_amount", 10, 10**9)],
        sort=[SortBy("revenue", descending=True), SortBy("title")],
        limit=20,
        offset=10,
        roots=[1, 2, 100, 1000],
        position="position",
    )
    return with_text(table, order_amount_chart="bigint")


def category_sketch_estimates(spark, folder):
    """Sellers, products and median price of every category's subtree over the days, from stored sketches."""
    market = sample.stored_market(spark, folder)
    states = stores.stage(sketches.category_day_states(market), "sketches")
    return sketches.range_estimates(market, states, START, AS_OF)


def products_order_chart(spark, folder):
    table = category.products_order_chart(sample.stored_market(spark, folder), START, AS_OF)
    return with_text(table, order_amount_chart="bigint")


def products_order_chart_filled(spark, folder):
    table = category.products_order_chart(
        sample.stored_market(spark, folder), START, AS_OF, filled=True
    )
    return with_text(table, order_amount_chart="bigint")


SALES_ARRAYS = {
    "order_graph": "bigint",
    "available_amount_graph": "bigint",
    "price_graph": "decimal(20,3)",
}


def category_sales_report(spark, folder):
    table = category.category_sales_report(sample.stored_market(spark, folder), START, AS_OF)
    return with_text(table, **SALES_ARRAYS)


# --- sellers and reports --------------------------------------------------


def seller_sales_report(spark, folder):
    table = seller.seller_sales_report(sample.stored_market(spark, folder), START, AS_OF)
    return with_text(table, **SALES_ARRAYS)


def seller_shops(spark, folder):
    market = sample.stored_market(spark, folder)
    sellers = upserts.sellers_of(market.products).drop("seen_at")
    return seller.seller_shops(sellers)


def abc_report(spark, folder):
    sales = seller.seller_sales_report(
        sample.stored_market(spark, folder), START, AS_OF, total=False
    )
    return report.abc_report(sales, ["seller_link"])


def abc_report_category(spark, folder):
    sales = category.category_sales_report(
        sample.stored_market(spark, folder), START, AS_OF, total=False
    )
    return report.abc_report(sales, ["category_id"])


def stock_days(spark, folder):
    sales = seller.seller_sales_report(
        sample.stored_market(spark, folder), START, AS_OF, total=False
    )
    return sales.select(
        "seller_link",
        "product_id",
        days_in_stock(F.col("available_amount_graph")).alias("days_in_stock"),
    )


# --- products -------------------------------------------------------------


def product_daily_analytics(spark, folder):
    table = product.product_daily_analytics(sample.stored_market(spark, folder), START, AS_OF)
    return with_text(
        table,
        price_chart="decimal(20,3)",
        revenue_chart="decimal(20,3)",
        order_chart="bigint",
        available_chart="bigint",
    )


def product_position_history(spark, folder):
    market = sample.stored_market(spark, folder)
    return product.product_position_history(market.positions, START, AS_OF)


# --- tables ---------------------------------------------------------------


def daily_sales(spark, folder):
    market = sample.stored_market(spark, folder)
    return rollup.daily_sales(market.sku_days(rollup.ATTRIBUTES))


def daily_sales_partials(spark, folder):
    """The mergeable rows themselves, straight from the given tables."""
    return rollup.observations(sample.product_snapshot(spark, folder))


def daily_sales_merge(spark, folder):
    """Two batches collapsed on their own and then merged."""
    raw = sample.stored_market(spark, folder).products
    early = F.dayofmonth("timestamp") % 3 == 0
    parts = rollup.observations(raw.where(early)).unionByName(
        rollup.observations(raw.where(~early))
    )
    return rollup.daily_sales(rollup.sku_days(rollup.merge(parts)))


def snapshot_idempotent(spark, folder):
    """One snapshot run published twice under one key; a killed run beside it stays unseen."""
    path = fresh_folder(spark, "snapshot")
    stats = stores.stage(category_period_stats(spark, folder), "stats")
    for _ in range(2):
        stores.publish_snapshot(stats, path, f"category-stats-{AS_OF}")
    # A run whose files were written but whose ledger entry never came.
    killed = stores.Store(spark, path).path("runs", "run-killed")
    stats.write.partitionBy("period", "snapshot_date", "root_id").parquet(killed)
    stores.vacuum_snapshots(spark, path)
    return stores.read_snapshots(spark, path).select(*stats.columns)


def latest_snapshot(spark, folder):
    days = sample.product_position(spark, folder).withColumn(
        "snapshot_date", F.to_date("timestamp")
    )
    return stores.latest(days)


def latest_per_period(spark, folder):
    """Newest snapshots where one period was not taken on the last days."""
    days = sample.product_position(spark, folder).withColumns(
        {
            "snapshot_date": F.to_date("timestamp"),
            "period": F.when(F.col("product_id") % 2 == 0, 7).otherwise(14),
        }
    )
    late = (F.col("period") == 14) & (F.col("snapshot_date") > F.lit(dt.date(2024, 1, 20)))
    return stores.latest(days.where(~late))


RETAINED_AT = dt.date(2024, 2, 15)


def purged(spark, rows, keep, as_of, sort, time="timestamp"):
    """Rows appended by month to a table of their own, purged in place, read back."""
    path = fresh_folder(spark, "retained")
    stores.append_series(rows, path, sort, time)
    stores.purge(spark, path, keep, as_of, time)
    return spark.read.parquet(path).drop("month")


def retention_raw(spark, folder):
    """Raw snapshots that four months of keeping leave on a later day, purged by partition."""
    raw = sample.stored_market(spark, folder).products.drop("month")
    kept = purged(spark, raw, stores.KEEP_RAW, dt.date(2024, 5, 20), ["product_id", "sku_id", "timestamp"])
    return kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("kept_rows"))


def retention_snapshots(spark, folder):
    """Snapshots of the last three days, by the day they are of."""
    days = sample.product_position(spark, folder).withColumn(
        "snapshot_date", F.to_date("timestamp").cast("timestamp_ntz")
    )
    kept = stores.retain(days, stores.KEEP_SNAPSHOTS, AS_OF, "snapshot_date")
    return kept.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("kept_rows"))


def report_export(spark, folder):
    """The ABC report written as CSV and read back."""
    path = fresh_folder(spark, "export")
    table = abc_report(spark, folder)
    report.export_report(table, path, ["seller_link"])
    read = spark.read.option("header", True).csv(path)
    casts = [F.col(f.name).cast(f.dataType) for f in table.schema if f.name in PLAIN]
    return read.select(*casts)


PLAIN = ["seller_link", "product_id", "days_in_stock", "order_amount", "revenue", "abc_orders", "abc_revenue"]


def retention(spark, folder):
    """Positions that a month of keeping leaves, purged by partition and read back."""
    positions = sample.product_position(spark, folder)
    kept = purged(spark, positions, stores.KEEP_POSITIONS, RETAINED_AT, ["category_id", "product_id", "timestamp"])
    return kept.select(*positions.columns)


def upsert_categories(spark, folder):
    """Half the tree renamed twice and one level added."""
    edges = sample.category_edges(spark, folder)
    even = F.col("category_id") % 2 == 0
    renamed = [
        edges.where(even)
        .withColumn("title", F.concat("title", F.lit(f" v{v}")))
        .withColumn("version", F.lit(v))
        for v in (1, 2)
    ]
    added = edges.where(F.col("category_id") >= 1000).select(
        (F.col("category_id") + 5000).alias("category_id"),
        F.col("category_id").alias("parent_category_id"),
        F.concat("title", F.lit("-new")).alias("title"),
        F.lit(1).alias("version"),
    )
    changes = renamed[0].unionByName(renamed[1]).unionByName(added)
    return upserts.upsert(edges, changes, upserts.CATEGORY_KEY, "version")


def upsert_sellers(spark, folder):
    """Sellers seen until mid-month under an old title, then all of them."""
    raw = sample.stored_market(spark, folder).products
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    current = (
        upserts.sellers_of(raw.where(F.col("timestamp") < middle))
        .drop("seen_at")
        .withColumn("title", F.concat("title", F.lit(" (old)")))
    )
    return upserts.upsert(current, upserts.sellers_of(raw), upserts.SELLER_KEY, "seen_at")


def payments_dedup(spark, folder):
    """Every payment delivered twice; failed ones are already known."""
    arrivals = sample.payments(spark, folder)
    later = arrivals.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    known = arrivals.where(F.col("status") == "failed")
    return upserts.insert_if_absent(
        known, arrivals.unionByName(later), upserts.PAYMENT_KEY, "created_at"
    )


def report_quota_usage(spark, folder):
    return audits.report_quota_usage(
        sample.report_requests(spark, folder), sample.user_plans(spark, folder)
    )


def request_entitlement_audit(spark, folder):
    return audits.request_entitlement_audit(
        sample.report_requests(spark, folder), sample.user_plans(spark, folder)
    )


# --- single operators -----------------------------------------------------


def _product_days(spark, folder, *attributes):
    market = sample.stored_market(spark, folder)
    return rollup.product_days(market.sku_days(list(attributes), START, AS_OF), [])


def order_delta(spark, folder):
    return with_orders(_product_days(spark, folder)).select("product_id", "date", "orders")


def order_delta_unclamped(spark, folder):
    days = with_orders(_product_days(spark, folder), clamp=False)
    return days.select("product_id", "date", "orders")


def sku_stock_sum(spark, folder):
    return _product_days(spark, folder).select("product_id", "date", "stock_sum")


def median_price(spark, folder):
    raw = sample.stored_market(spark, folder).products
    return grouped_median(raw, ["latest_category_id"], "purchase_price", "median_price")


def median_merge(spark, folder):
    market = sample.stored_market(spark, folder)
    skus = market.sku_days(["purchase_price"])
    merged = F.flatten(F.collect_list("price_hist"))
    return skus.groupBy("product_id", "date").agg(hist_median(merged).alias("median_price"))


def distinct_sellers_products(spark, folder):
    market = sample.stored_market(spark, folder)
    return category.distinct_counts(market, market.sku_days([], START, AS_OF), [])


def distinct_with_sales(spark, folder):
    return snapshots.category_daily_stats(sample.stored_market(spark, folder)).select(
        "category_id", "date", "seller_with_sales", "product_with_sales"
    )


def median_with_sales(spark, folder):
    return snapshots.category_daily_stats(sample.stored_market(spark, folder)).select(
        "category_id", "date", "median_price_with_sales"
    )


def first_last_value(spark, folder):
    """Rows first collapse to the span of each combination of values."""
    seen = (
        sample.stored_market(spark, folder)
        .products.groupBy("product_id", "sku_id", "purchase_price", "full_price", "photo_key")
        .agg(F.min("timestamp").alias("since"), F.max("timestamp").alias("until"))
    )
    first, last = (F.col("since"), F.col("sku_id")), (F.col("until"), F.col("sku_id"))
    return seen.groupBy("product_id").agg(
        first_value(F.col("purchase_price"), *first).alias("first_price"),
        last_value(F.col("purchase_price"), *last).alias("last_price"),
        first_value(F.col("full_price"), *first).alias("first_full_price"),
        last_value(F.col("photo_key"), *last).alias("last_photo_key"),
    )


def ordered_array_agg(spark, folder):
    days = _product_days(spark, folder)
    table = days.groupBy("product_id").agg(
        ordered_array(F.col("date"), F.col("high")).alias("counter_chart")
    )
    return with_text(table, counter_chart="bigint")


def gap_fill_rows(spark, folder):
    days = with_orders(_product_days(spark, folder)).select("product_id", "date", "orders")
    return gap_fill(days, ["product_id"], START, AS_OF, {"orders": 0})


def gap_fill_carry_rows(spark, folder):
    days = with_orders(_product_days(spark, folder, "photo_key")).select(
        "product_id", "date", "orders", F.col("last_photo_key.value").alias("photo_key")
    )
    return gap_fill_carry(days, ["product_id"], START, AS_OF, ["photo_key"], {"orders": 0})


def abc_classes(spark, folder):
    quantity = F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    sold = sample.table(spark, folder, "lineitem").groupBy("l_returnflag", "l_partkey")
    return abc_classify(sold.agg(quantity), ["l_returnflag"], {"quantity": "abc"})


def dynamic_filters(spark, folder):
    table = daily_sales(spark, folder).select(
        "date", "product_id", "sku_id", "title", "median_price", "is_eco"
    )
    return dynamic_filter(
        table,
        [
            Contains("title", "p1"),
            Between("median_price", 100000, 110000),
            Between("date", dt.date(2024, 1, 5), dt.date(2024, 1, 20)),
            Equals("is_eco", True),
        ],
    )


def page_of_products(spark, folder):
    market = sample.stored_market(spark, folder)
    sales = product.products_sales(market, START, AS_OF).select(
        "product_id", "order_amount", "sales_amount"
    )
    return page(sales, [SortBy("order_amount", descending=True)], limit=50, offset=25)


def period_ranges(spark, folder):
    days = sample.stored_market(spark, folder).products.select(F.to_date("timestamp").alias("date"))
    windows = F.array(
        *(
            F.struct(
                F.lit(name).alias("period"),
                F.lit(period_range(AS_OF, name)[0]).alias("from_date"),
                F.lit(period_range(AS_OF, name)[1]).alias("to_date"),
            )
            for name in PERIOD_DAYS
        )
    )
    fits = F.filter(windows, lambda w: F.col("date").between(w["from_date"], w["to_date"]))
    return days.select(F.inline(fits)).groupBy("period", "from_date", "to_date").agg(
        F.count(F.lit(1)).alias("snapshots")
    )


def pct_diffs(spark, folder):
    """Each day of a category against the day before."""
    market = sample.stored_market(spark, folder)
    daily = category.category_daily_analytics(market, START, AS_OF)
    earlier = daily.select(
        "category_id",
        F.date_add("date", 1).alias("date"),
        F.col("revenue").alias("prev_revenue"),
        F.col("order_amount").alias("prev_order_amount"),
    )
    return daily.join(earlier, ["category_id", "date"]).select(
        "category_id",
        "date",
        pct_diff(F.col("prev_revenue"), F.col("revenue")).alias("revenue_pct"),
        pct_diff_count(F.col("prev_order_amount"), F.col("order_amount")).alias("orders_pct"),
    )


def trunc_decimals(spark, folder):
    share = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast(
        "decimal(4,2)"
    ) - F.lit(100).cast("decimal(3,0)")
    return sample.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        trunc_decimal(share, 1).alias("discount_over_100"),
    )


def money(spark, folder):
    share = F.lit("0.123456789").cast("decimal(10,9)")
    amount = to_money(F.col("o_totalprice").cast("decimal(18,2)") * share - F.lit(20000))
    return sample.table(spark, folder, "orders").select("o_orderkey", F.inline(F.array(amount)))


MARKET_QUERIES: dict[str, Query] = {
    "category_daily_analytics": _market_query(category.category_daily_analytics, START, AS_OF),
    "category_analytics_adhoc": _market_query(category.category_analytics_adhoc, START, AS_OF),
    "category_overall_info": _market_query(category.category_overall_info, START, AS_OF),
    "category_daily_stats": _market_query(snapshots.category_daily_stats),
    "product_first_discovered": _market_query(product.product_first_discovered),
    "product_sku_history": _market_query(product.product_sku_history, START, AS_OF),
    "products_sales": _market_query(product.products_sales, START, AS_OF),
    "seller_overall_info": _market_query(seller.seller_overall_info, START, AS_OF),
    "seller_order_dynamic": _market_query(seller.seller_order_dynamic, START, AS_OF),
}

QUERIES: dict[str, Query] = {
    **MARKET_QUERIES,
    "category_descendants": category_descendants,
    "category_subtree": category_subtree,
    "category_hierarchy": category_hierarchy,
    "category_title": category_title,
    "category_period_stats": category_period_stats,
    "category_analytics_with_prev": category_analytics_with_prev,
    "category_children_ranking": category_children_ranking,
    "category_product_period_stats": category_product_period_stats,
    "category_products_analytics": category_products_analytics,
    "category_products_page": category_products_page,
    "category_sketch_estimates": category_sketch_estimates,
    "products_order_chart": products_order_chart,
    "products_order_chart_filled": products_order_chart_filled,
    "category_sales_report": category_sales_report,
    "product_daily_analytics": product_daily_analytics,
    "product_position_history": product_position_history,
    "seller_sales_report": seller_sales_report,
    "seller_shops": seller_shops,
    "abc_report": abc_report,
    "abc_report_category": abc_report_category,
    "days_in_stock": stock_days,
    "daily_sales": daily_sales,
    "daily_sales_partials": daily_sales_partials,
    "daily_sales_merge": daily_sales_merge,
    "snapshot_idempotent": snapshot_idempotent,
    "latest_snapshot": latest_snapshot,
    "latest_per_period": latest_per_period,
    "retention": retention,
    "retention_raw": retention_raw,
    "retention_snapshots": retention_snapshots,
    "report_export": report_export,
    "upsert_categories": upsert_categories,
    "upsert_sellers": upsert_sellers,
    "payments_dedup": payments_dedup,
    "report_quota_usage": report_quota_usage,
    "request_entitlement_audit": request_entitlement_audit,
    "order_delta": order_delta,
    "order_delta_unclamped": order_delta_unclamped,
    "sku_stock_sum": sku_stock_sum,
    "median_price": median_price,
    "median_merge": median_merge,
    "distinct_sellers_products": distinct_sellers_products,
    "distinct_with_sales": distinct_with_sales,
    "median_with_sales": median_with_sales,
    "first_last_value": first_last_value,
    "ordered_array_agg": ordered_array_agg,
    "gap_fill": gap_fill_rows,
    "gap_fill_carry": gap_fill_carry_rows,
    "abc_classify": abc_classes,
    "dynamic_filter": dynamic_filters,
    "page": page_of_products,
    "period_range": period_ranges,
    "pct_diff": pct_diffs,
    "trunc_decimal": trunc_decimals,
    "to_money": money,
    **streams.QUERIES,
}
