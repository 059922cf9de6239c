"""Latest-wins dimensions and insert-if-absent facts without a lakehouse format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORY_KEY = ["category_id"]
SELLER_KEY = ["seller_id", "account_id"]
PAYMENT_KEY = ["payment_id"]


def latest_wins(changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key: the one with the greatest version, ties by its values.

    The whole row travels in one struct maximum, combined before the shuffle.
    """
    values = [c for c in changes.columns if c not in (*key, version)]
    newest = F.max(F.struct(version, *values)).alias("_row")
    return changes.groupBy(*key).agg(newest).select(
        *key, *(F.col("_row")[c].alias(c) for c in values)
    )


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str):
    """``current`` with every key of ``changes`` inserted or replaced."""
    values = [c for c in changes.columns if c != version]
    newest = latest_wins(changes, key, version).select(*values)
    kept = current.join(newest.select(*key), key, "left_anti")
    return kept.select(*values).unionByName(newest)


def insert_if_absent(
    current: DataFrame, arrivals: DataFrame, key: list[str], order: str
) -> DataFrame:
    """Rows of ``arrivals`` whose key is new; of repeated keys the first by ``order``."""
    values = [c for c in arrivals.columns if c not in (*key, order)]
    first = F.min(F.struct(order, *values)).alias("_row")
    fresh = arrivals.groupBy(*key).agg(first).select(
        *key, *(F.col("_row")[c].alias(c) for c in (order, *values))
    )
    return fresh.join(current.select(*key), key, "left_anti").select(*arrivals.columns)


def sellers_of(products: DataFrame) -> DataFrame:
    """Distinct sellers with the time each version was last seen."""
    return products.groupBy(
        "seller_id",
        F.col("seller_account_id").alias("account_id"),
        F.col("seller_link").alias("link"),
        F.col("seller_title").alias("title"),
    ).agg(F.max("timestamp").alias("seen_at"))
