"""Seller questions answered from the roll-up, for one seller or for all."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.numbers import ratio
from tallymart.marketplace import Marketplace
from tallymart.operators.counters import with_orders
from tallymart.operators.shaping import page, staged_with_total, with_total
from tallymart.plans.rollup import product_days, with_median
from tallymart.plans.sales import product_sales

SCOPE = ["seller_link"]


def seller_days(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    attributes: Sequence[str],
    links: Sequence[str] | None = None,
) -> DataFrame:
    """Product-day states per seller link, with ``orders`` and the median if priced."""
    asked = None if links is None else F.col("seller_link").isin(list(links))
    member = None if asked is None else lambda rows: rows.where(asked)
    skus = market.sku_days(["seller_link", *attributes], start, end, member)
    if asked is not None:
        skus = skus.where(asked)
    days = product_days(skus, SCOPE)
    if "purchase_price" in attributes:
        days = with_median(days)
    return with_orders(days, *SCOPE)


def seller_order_dynamic(
    market: Marketplace, start: dt.date, end: dt.date, links: Sequence[str] | None = None
) -> DataFrame:
    """Orders per seller and day."""
    days = seller_days(market, start, end, [], links)
    return days.groupBy(*SCOPE, "date").agg(F.sum("orders").alias("order_amount"))


def seller_overall_info(
    market: Marketplace, start: dt.date, end: dt.date, links: Sequence[str] | None = None
) -> DataFrame:
    """Orders, revenue and product counts per seller.

    The average price divides the prices of all products by the number of
    products *with sales*; results are expected that way.
    """
    days = seller_days(market, start, end, ["purchase_price"], links)
    products = days.groupBy(*SCOPE, "product_id").agg(
        F.sum("orders").alias("orders"),
        F.sum(F.col("orders") * F.col("median")).alias("minor"),
        (F.sum("median") / 100 / F.count(F.lit(1))).alias("avg_price"),
    )
    sold = F.count_if(F.col("orders") > 0)
    return products.groupBy(*SCOPE).agg(
        F.sum("orders").alias("order_amount"),
        (F.sum("minor") / 100).alias("revenue"),
        F.count(F.lit(1)).alias("product_count"),
        sold.alias("product_with_sales"),
        F.round(ratio(F.sum("avg_price"), sold)).alias("avg_price"),
        F.count_if(F.col("orders") <= 0).alias("product_without_sales"),
    )


def seller_sales_report(
    market: Marketplace,
    start: dt.date,
    end: dt.date,
    links: Sequence[str] | None = None,
    limit: int | None = None,
    offset: int = 0,
    total: bool = True,
) -> DataFrame:
    """Sales report of the products of each seller, with their number if asked."""
    days = seller_days(market, start, end, ["purchase_price", "title", "seller_title"], links)
    report = product_sales(market, days, SCOPE)
    if total:
        report = staged_with_total(report, SCOPE)
    if limit is None and not offset:
        return report
    return page(report, (), [*SCOPE, "product_id"], limit, offset)


def seller_shops(sellers: DataFrame, links: Sequence[str] | None = None) -> DataFrame:
    """Every shop of the accounts behind the links, each once, with its account's size.

    Shops meet their account, not each other, so nothing grows with the square
    of an account.
    """
    if links is not None:
        asked = sellers.where(F.col("link").isin(list(links))).select("account_id")
        sellers = sellers.join(asked, "account_id", "left_semi")
    return with_total(sellers, ["account_id"], "shops")
