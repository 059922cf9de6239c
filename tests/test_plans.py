"""Plans that hold at scale, and narrowed queries that equal the whole."""

import datetime as dt
import re
import statistics

import pytest
from pyspark.sql import functions as F
from test_properties import by_row, random_snapshots

from tallymart import Marketplace
from tallymart.operators.shaping import SortBy
from tallymart.operators.sizes import sized_broadcast
from tallymart.plans import category, product, report, rollup, seller, snapshots
from tallymart.sources.stores import append_series, between, latest

START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 6)


@pytest.fixture(scope="module")
def shop(spark, snapshots, edges, tmp_path_factory):
    rows = random_snapshots(21, 250)
    for i, row in enumerate(rows):
        row["seller_link"] = f"shop{row['product_id'] % 2}" if i % 9 else "shop0"
    folder = tmp_path_factory.mktemp("shop")
    raw, partials = str(folder / "raw"), str(folder / "rollup")
    append_series(snapshots(rows), raw, ["product_id", "sku_id", "timestamp"])
    stored = spark.read.parquet(raw)
    append_series(rollup.observations(stored), partials, ["product_id", "date"], "date")
    return Marketplace(
        products=stored, categories=edges, partials=spark.read.parquet(partials)
    )


def physical(table):
    return table._jdf.queryExecution().executedPlan().toString()


BATCH = {
    "category days": lambda m: category.category_daily_analytics(m, START, END),
    "category report": lambda m: category.category_sales_report(m, START, END),
    "seller info": lambda m: seller.seller_overall_info(m, START, END),
    "seller report": lambda m: seller.seller_sales_report(m, START, END),
    "product analytics": lambda m: product.product_daily_analytics(m, START, END),
    "sku history": lambda m: product.product_sku_history(m, START, END),
    "period stats": lambda m: snapshots.category_period_stats(m, END),
    "product stats": lambda m: snapshots.category_product_period_stats(m, END),
    "daily stats": lambda m: snapshots.category_daily_stats(m),
}


@pytest.mark.parametrize("name", BATCH)
def test_no_single_task_no_python_no_cross_join(shop, name):
    plan = physical(BATCH[name](shop))
    assert "SinglePartition" not in plan
    assert not re.search(r"Python|InPandas|CartesianProduct|NestedLoop", plan)


def test_tree_is_broadcast_and_scan_is_pruned(shop):
    plan = physical(category.category_daily_analytics(shop, START, END))
    assert "BroadcastHashJoin" in plan
    assert re.search(r"PartitionFilters: \[[^]]*month", plan)
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(date", plan)
    columns = re.search(r"FileScan parquet \[([^]]*)\]", plan).group(1)
    assert "purchase_price" in columns
    assert "title" not in columns and "photo_key" not in columns


def test_product_queries_shuffle_by_product_once(shop):
    plan = physical(seller.seller_order_dynamic(shop, START, END))
    assert plan.count("Exchange hashpartitioning") == 3  # merge, product, result
    assert plan.count("REPARTITION_BY_COL") == 1


def test_large_tables_are_not_broadcast(spark):
    small = spark.range(10)
    assert "broadcast" in str(sized_broadcast(small, 10)._jdf.queryExecution().logical())
    assert "broadcast" not in str(sized_broadcast(small, 9)._jdf.queryExecution().logical())


def test_shuffled_tree_gives_the_same(shop, monkeypatch):
    want = by_row(category.category_daily_analytics(shop, START, END))
    monkeypatch.setattr("tallymart.marketplace.sized_broadcast", lambda t: t)
    other = Marketplace(shop.products, shop.categories, partials=shop.partials)
    assert by_row(category.category_daily_analytics(other, START, END)) == want


def test_stored_and_derived_rollup_agree(shop):
    derived = Marketplace(shop.products, shop.categories)
    for run in (BATCH["category report"], BATCH["seller report"], BATCH["product analytics"]):
        assert by_row(run(derived)) == by_row(run(shop))


NARROW = {
    "daily": category.category_daily_analytics,
    "adhoc": category.category_analytics_adhoc,
    "overall": category.category_overall_info,
    "report": category.category_sales_report,
}


@pytest.mark.parametrize("name", NARROW)
def test_one_category_equals_its_part_of_all(shop, name):
    whole = NARROW[name](shop, START, END)
    for root in (2, 3):
        part = NARROW[name](shop, START, END, roots=[root])
        assert by_row(part) == by_row(whole.where(F.col("category_id") == root))


@pytest.mark.parametrize(
    "run", [seller.seller_order_dynamic, seller.seller_overall_info, seller.seller_sales_report]
)
def test_one_seller_equals_its_part_of_all(shop, run):
    part = run(shop, START, END, links=["shop1"])
    assert part.count()
    assert by_row(part) == by_row(run(shop, START, END).where("seller_link = 'shop1'"))


def test_one_product_equals_its_part_of_all(shop):
    for run in (product.product_daily_analytics, product.product_sku_history, product.products_sales):
        assert by_row(run(shop, START, END, products=[1])) == by_row(
            run(shop, START, END).where("product_id = 1")
        )


def test_page_of_category_products(shop, tmp_path):
    stats = snapshots.category_product_period_stats(shop, END, [7])
    everything = category.category_products_analytics(shop, stats, START, END, roots=[1])
    order = [SortBy("order_amount", descending=True)]
    paged = category.category_products_analytics(
        shop, stats, START, END, sort=order, limit=2, offset=1, roots=[1]
    )
    rows = everything.orderBy(F.desc("order_amount"), "product_id").collect()
    assert sorted(map(str, paged.select(*everything.columns).collect())) == sorted(map(str, rows[1:3]))
    assert {r.total_row_count for r in rows} == {len(rows)}


def test_latest_reads_only_the_newest_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, dt.date(2024, 1, d)) for d in (1, 2, 3)]
    table = spark.createDataFrame(rows, "v int, snapshot_date date")
    table.write.partitionBy("snapshot_date").parquet(path)
    newest = latest(spark.read.parquet(path))
    assert [r.snapshot_date.day for r in newest.collect()] == [3]
    assert re.search(r"PartitionFilters: \[[^]]*[sS]ubquery", physical(newest))


def test_between_is_inclusive_of_whole_days(shop):
    one = between(shop.products, START, START)
    assert one.where(F.to_date("timestamp") != F.lit(START)).count() == 0
    assert one.count() == shop.products.where(F.to_date("timestamp") == F.lit(START)).count()


def test_approximate_counts_are_close(shop):
    skus = shop.sku_days([], START, END)
    exact = {r.root_id: r.product_count for r in category.distinct_counts(shop, skus, []).collect()}
    near = category.distinct_counts(shop, skus, [], approximate=True).collect()
    assert all(abs(r.product_count - exact[r.root_id]) <= 1 for r in near)


def test_report_export(shop, spark, tmp_path):
    sales = seller.seller_sales_report(shop, START, END)
    table = report.abc_report(sales, ["seller_link"])
    report.export_report(table, str(tmp_path / "csv"), ["seller_link"])
    written = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert written.count() == table.count()
    assert set(written.columns) == {"seller_link", *report.COLUMNS}


BELOW = {1: {2, 3, 4}, 2: {4}, 3: {3}, 4: {4}}


def brute_category_days(rows):
    """Orders, stock and revenue by root and day, the direct way."""
    placed = {}
    for r in rows:
        sku_day = (r["product_id"], r["sku_id"], r["timestamp"].date())
        placed[sku_day] = max(placed.get(sku_day, 0), r["latest_category_id"])
    out = {}
    for root, inside in BELOW.items():
        days = {}
        for r in rows:
            day = r["timestamp"].date()
            if placed[r["product_id"], r["sku_id"], day] in inside:
                days.setdefault((r["product_id"], day), []).append(r)
        last = {}
        for (item, day), seen in sorted(days.items(), key=lambda x: x[0]):
            counts = [r["total_orders_amount"] for r in seen]
            before = last.get(item, 0)
            orders = max(0, max(counts) - (before if before > 0 else min(counts)))
            last[item] = max(counts)
            price = statistics.median([r["purchase_price"] for r in seen])
            sums = out.setdefault((root, day), [0, 0, 0.0])
            sums[0] += orders
            sums[1] += min(r["available_amount"] for r in seen)
            sums[2] += orders * price
    return {key: (n, stock, round(minor / 100, 2)) for key, (n, stock, minor) in out.items()}


@pytest.mark.parametrize("seed", [31, 32])
def test_products_that_move_and_products_that_stay(market, seed):
    rows = random_snapshots(seed, 400)
    for row in rows:
        if row["product_id"] in (0, 1):
            row["latest_category_id"] = 4 - row["product_id"]
    table = category.category_daily_analytics(market(rows), START, END)
    got = {
        (r.category_id, r.date): (r.order_amount, r.available_amount, r.revenue)
        for r in table.collect()
    }
    assert got == brute_category_days(rows)
