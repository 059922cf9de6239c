"""Hand-worked vectors for every custom operator."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import at
from pyspark.sql import functions as F

from tallymart.functions.arrays import days_in_stock, hist_median, ordered_array
from tallymart.functions.numbers import pct_diff, pct_diff_count, to_money, trunc_decimal
from tallymart.functions.periods import period_range, snapshot_period
from tallymart.operators import hierarchy
from tallymart.operators.abc import abc_classify
from tallymart.operators.counters import previous, stock_delta, stock_orders, with_orders
from tallymart.operators.gaps import gap_fill, gap_fill_carry
from tallymart.operators.shaping import Between, Contains, Equals, SortBy, dynamic_filter, page
from tallymart.plans import audits, category, product, seller

DAY = dt.date(2024, 1, 1)


def day(n):
    return dt.date(2024, 1, n)


def test_order_delta(spark):
    rows = [(1, day(1), 100, 104), (1, day(2), 104, 104), (1, day(3), 110, 115)]
    rows += [(1, day(5), 108, 112), (1, day(6), 112, 120)]
    days = spark.createDataFrame(rows, "product_id bigint, date date, low bigint, high bigint")
    clamped = with_orders(days).orderBy("date").collect()
    assert [r.orders for r in clamped] == [4, 0, 11, 0, 8]
    raw = with_orders(days, clamp=False).orderBy("date").collect()
    assert [r.orders for r in raw] == [4, 0, 11, -3, 8]


def test_stock_delta(spark):
    rows = [
        (day(1), 20, 25, 20, 5, 0),
        (day(2), 15, 18, 15, 3, 0),
        (day(3), 12, 12, 12, 3, 0),
        (day(4), 30, 40, 30, 1, 0),
        (day(5), 5, 5, 5, 18, 5),
        (day(6), 5, 5, 5, 0, 0),
    ]
    days = spark.createDataFrame(
        rows, "date date, low bigint, high bigint, last bigint, span bigint, restriction int"
    ).withColumn("product_id", F.lit(1))
    before = days.withColumn("before", previous("last", "product_id"))
    moved = stock_delta(F.col("low"), F.col("high"), F.col("before"))
    orders = stock_orders(F.col("restriction"), F.col("span"), moved)
    got = [r[0] for r in before.orderBy("date").select(orders).collect()]
    assert got == [0, 3, 3, 0, 18, 0]


def test_gap_fill(spark):
    rows = spark.createDataFrame([(1, day(2), 7), (1, day(4), 3)], "k int, date date, position int")
    dense = gap_fill(rows, ["k"], day(1), day(6), {"position": 0}).orderBy("date").collect()
    assert [r.position for r in dense] == [0, 7, 0, 3, 0]
    assert [r.date for r in dense] == [day(n) for n in range(1, 6)]


def test_gap_fill_keeps_the_end_day_if_observed(spark):
    rows = spark.createDataFrame([(1, day(3), 7)], "k int, date date, position int")
    dense = gap_fill(rows, ["k"], day(1), day(3), {"position": 0}).orderBy("date").collect()
    assert [(r.date, r.position) for r in dense] == [(day(1), 0), (day(2), 0), (day(3), 7)]


def test_gap_fill_carry(spark):
    rows = spark.createDataFrame(
        [(1, day(2), "A", 3), (1, day(4), "B", 2)], "k int, date date, title string, orders int"
    )
    dense = gap_fill_carry(rows, ["k"], day(1), day(6), ["title"], {"orders": 0})
    got = [(r.title, r.orders) for r in dense.orderBy("date").collect()]
    assert got == [("A", 3), ("A", 0), ("B", 2), ("B", 0)]


def test_product_daily_analytics(market):
    shop = market(
        [
            {"timestamp": at(2, 8), "title": "A", "total_orders_amount": 10, "available_amount": 9},
            {"timestamp": at(2, 9), "title": "A", "total_orders_amount": 13, "available_amount": 9},
            {
                "timestamp": at(4),
                "title": "B",
                "total_orders_amount": 15,
                "purchase_price": 110,
                "available_amount": 7,
                "full_price": 150,
            },
        ]
    )
    row = product.product_daily_analytics(shop, day(1), day(6)).first()
    assert (row.title, row.category_id, row.category_name) == ("B", 4, "four")
    assert row.order_chart == [3, 0, 2, 0]
    assert row.price_chart == pytest.approx([1.0, 0, 1.1, 0])
    assert row.revenue_chart == pytest.approx([3.0, 0, 2.2, 0])
    assert row.available_chart == [9, 7]
    assert (row.price, row.photo_key, row.full_price) == (0, "", 150)
    assert row.revenue_sum == 5.2
    assert row.first_discovered == day(2)


def test_median_of_merged_histograms(spark):
    hist = spark.createDataFrame(
        [([(9, 1), (1, 2), (5, 1)],), ([(4, 3)],), ([],)],
        "h array<struct<price: bigint, cnt: bigint>>",
    )
    assert [r[0] for r in hist.select(hist_median(F.col("h"))).collect()] == [3.0, 4.0, None]


def test_ordered_array_and_days_in_stock(spark):
    rows = spark.createDataFrame([(day(3), 5), (day(1), 0), (day(2), 2)], "d date, v bigint")
    row = rows.agg(ordered_array(F.col("d"), F.col("v")).alias("a")).select(
        "a", days_in_stock(F.col("a"))
    )
    assert tuple(row.first()) == ([0, 2, 5], 2)


def test_subtree(edges):
    pairs = hierarchy.closure(edges)
    below = {(r.root_id, r.category_id) for r in hierarchy.subtree(edges, pairs).collect()}
    assert below == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 3), (4, 4)}
    assert {r.category_id for r in hierarchy.descendants(pairs, 0, 1).collect()} == {1}
    assert {r.category_id for r in hierarchy.descendants(pairs, 0).collect()} == {1, 2, 3, 4}


def test_a_cycle_is_an_error(spark):
    loop = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "category_id int, parent_category_id int, title string")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(loop)


def classes(spark, values):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "r string, i int, v bigint")
    return [r.c for r in abc_classify(rows, ["r"], {"v": "c"}).orderBy("i").collect()]


def test_abc(spark):
    assert classes(spark, [500, 300, 100, 50, 50, 0]) == ["A", "A", "B", "B", "B", "C"]
    assert classes(spark, [90, 10]) == ["B", "C"]
    assert classes(spark, [0, 0]) == [None, None]


def test_percentages(spark):
    pairs = [(100, 150), (150, 100), (3, 4), (7, 6), (0, 5), (0, 0), (160, 252)]
    rows = spark.createDataFrame(pairs, "p bigint, c bigint")
    got = rows.select(pct_diff(F.col("p"), F.col("c")), pct_diff_count(F.col("p"), F.col("c")))
    expected = ["50.0", "-33.3", "33.3", "-14.2", "0.0", "0.0"]
    assert [r[0] for r in got.collect()] == [Decimal(x) for x in [*expected, "57.5"]]
    # Counts go through doubles, where 0.575 * 100 falls just short.
    assert [r[1] for r in got.collect()] == [Decimal(x) for x in [*expected, "57.4"]]


def test_money_and_truncation(spark):
    rows = spark.createDataFrame([(Decimal("12.345"),), (Decimal("-1.5"),)], "a decimal(20,9)")
    got = [r[0] for r in rows.select(to_money(F.col("a"))).collect()]
    assert [(m.currency_code, m.units, m.nanos) for m in got] == [
        ("860", 12, 345000000),
        ("860", -1, -500000000),
    ]
    cut = [r[0] for r in rows.select(trunc_decimal(F.col("a"), 1)).collect()]
    assert cut == [Decimal("12.3"), Decimal("-1.5")]


def test_periods():
    assert period_range(dt.date(2024, 1, 31), "month") == (day(1), dt.date(2024, 1, 31))
    assert period_range(dt.date(2024, 1, 31)) == (day(24), dt.date(2024, 1, 31))
    assert snapshot_period() == 30


def test_seller_average_price_counts_products_with_sales(market):
    shop = market(
        [
            {"timestamp": at(1, 1), "total_orders_amount": 5, "purchase_price": 1000},
            {"timestamp": at(1, 2), "total_orders_amount": 9, "purchase_price": 1000},
            {"timestamp": at(1, 1), "product_id": 2, "sku_id": 20, "purchase_price": 3000},
        ]
    )
    row = seller.seller_overall_info(shop, day(1), day(3)).first()
    assert (row.order_amount, row.product_count, row.avg_price) == (4, 2, 40)
    assert (row.product_with_sales, row.product_without_sales) == (1, 1)


def test_lag_sees_only_days_within_the_category(market):
    """A day spent in another category is skipped, not counted as zero."""
    rows = [
        {"timestamp": at(1), "total_orders_amount": 10, "latest_category_id": 4},
        {"timestamp": at(2), "total_orders_amount": 15, "latest_category_id": 3},
        {"timestamp": at(3), "total_orders_amount": 22, "latest_category_id": 4},
    ]
    table = category.category_daily_analytics(market(rows), day(1), day(9))
    got = {(r.category_id, r.date.day): r.order_amount for r in table.collect()}
    assert got[4, 3] == 12 and got[1, 3] == 7 and got[3, 2] == 0


def test_entitlements(spark):
    as_of = dt.datetime(2024, 1, 31)
    plans = spark.createDataFrame(
        [
            (1, "default", dt.datetime(2030, 1, 1)),
            (2, "pro", dt.datetime(2030, 1, 1)),
            (3, "pro", dt.datetime(2000, 1, 1)),
            (4, None, None),
        ],
        "user_id bigint, subscription_type string, subscription_end_at timestamp_ntz",
    )

    def asks(job, user, ago, days):
        start = as_of.date() - dt.timedelta(days=ago)
        return (job, user, as_of, start, start + dt.timedelta(days=days))

    requests = spark.createDataFrame(
        [
            asks(1, 1, 31, 31),
            asks(2, 1, 31, 30),
            asks(3, 1, 32, 30),
            asks(4, 2, 900, 120),
            asks(5, 3, 5, 5),
            asks(6, 4, 5, 5),
            asks(7, 4, 5, 0),
        ],
        "job_id bigint, user_id bigint, created_at timestamp_ntz, from_date date, to_date date",
    )
    got = audits.request_entitlement_audit(requests, plans).orderBy("job_id").collect()
    p, n = "PERMIT", "PROHIBIT"
    assert [r.verdict for r in got] == [n, p, n, p, n, n, p]


def test_filters_sorting_and_paging(spark):
    rows = spark.createDataFrame(
        [(1, "Red hat", 5), (2, "red shoe", 9), (3, "blue hat", 9)],
        "product_id int, title string, orders int",
    )
    kept = dynamic_filter(rows, [Contains("title", "RED"), Between("orders", 5, 9)])
    assert {r.product_id for r in kept.collect()} == {1, 2}
    assert dynamic_filter(rows, [Equals("orders", 9)]).count() == 2
    second = page(rows, [SortBy("orders", descending=True)], limit=1, offset=1)
    assert [r.product_id for r in second.collect()] == [3]
    with pytest.raises(ValueError, match="Unknown field name"):
        page(rows, [SortBy("price")])


def test_ranking_rejects_unknown_names(market):
    with pytest.raises(ValueError, match="Unknown field name"):
        category.category_children_ranking(market([]), None, [SortBy("available")])


def test_empty_category_report_is_an_empty_table(market):
    assert category.category_sales_report(market([]), day(1), day(5)).count() == 0
