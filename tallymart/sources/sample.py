"""The canonical tables derived from the star-schema sample data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart import schemas
from tallymart.marketplace import Marketplace
from tallymart.operators.running import running_sums
from tallymart.plans import rollup
from tallymart.session import fresh_folder
from tallymart.sources.stores import append_series

START = dt.date(2024, 1, 1)
AS_OF = dt.date(2024, 1, 31)

_MARKETS: dict[tuple[str, str], Marketplace] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _numbered_events(events: DataFrame) -> DataFrame:
    """Events with running numbers and a running order count per product."""
    marked = events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("product_id"),
        "event_type",
        F.lit(1).alias("n"),
        (F.col("event_id") % 2).alias("odd"),
        F.floor(F.col("value") / 20).cast("bigint").alias("steps"),
    )
    hour = F.date_trunc("hour", "ts")
    order = ["ts", "event_id"]
    summed = running_sums(marked, ["product_id"], hour, order, ["n", "odd", "steps"])
    odd = F.col("odd_upto")
    return summed.select(
        "event_id",
        "ts",
        "product_id",
        "event_type",
        F.col("odd").alias("parity"),
        F.col("n_upto").alias("n"),
        F.when(F.col("odd") == 1, odd).otherwise(F.col("n_upto") - odd).alias("n_parity"),
        F.col("steps_upto").alias("steps"),
    )


def _category_of(product: F.Column) -> F.Column:
    return F.when(product % 50 == 49, F.lit(124)).otherwise(1000 + product % 50).cast("bigint")


def product_snapshot(
    spark: SparkSession, folder: str, numbered: bool = False
) -> DataFrame:
    """Every event is one scrape of a product's SKU; ``numbered`` keeps its id."""
    rows = _numbered_events(table(spark, folder, "events"))
    product, seller = F.col("product_id"), F.col("product_id") % 20
    dip = F.when(F.col("event_type") == "error", 8).otherwise(0)
    return rows.select(
        *(["event_id"] if numbered else []),
        F.col("ts").alias("timestamp"),
        product,
        (product * 10 + F.col("parity")).alias("sku_id"),
        F.concat(F.lit("P"), product.cast("string")).alias("title"),
        (F.lit(3) + seller / 10).cast("decimal(9,2)").alias("rating"),
        _category_of(product).alias("latest_category_id"),
        F.floor(F.col("n") / 3).cast("bigint").alias("reviews_amount"),
        (F.col("steps") + 10 - dip).cast("bigint").alias("total_orders_amount"),
        (500 - F.col("n") % 53 * 7).cast("bigint").alias("total_available_amount"),
        (200 - F.col("n_parity") % 41 * 5).cast("bigint").alias("available_amount"),
        F.concat(F.lit("ph"), (F.col("event_id") % 4).cast("string")).alias("photo_key"),
        seller.alias("seller_id"),
        (500 + seller % 7).alias("seller_account_id"),
        F.concat(F.lit("Shop "), seller.cast("string")).alias("seller_title"),
        F.concat(F.lit("shop-"), seller.cast("string")).alias("seller_link"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), seller.cast("int"))
        .cast("timestamp_ntz")
        .alias("seller_registration_date"),
        (product % 3 == 0).alias("is_eco"),
        (product % 11 == 0).alias("is_adult"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None))
        .otherwise(105000 + product % 17 * 1000)
        .cast("bigint")
        .alias("full_price"),
        (100000 + product % 17 * 1000 + F.col("event_id") % 7 * 100)
        .cast("bigint")
        .alias("purchase_price"),
        F.when(product % 10 == 0, 5).otherwise(0).cast("smallint").alias("restriction"),
    )


def category_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Regions above nations above one or two leaves each."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")

    def edge(source, category, parent, title):
        return source.select(
            category.cast("bigint").alias("category_id"),
            parent.cast("bigint").alias("parent_category_id"),
            title.alias("title"),
        )

    return (
        edge(region, F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"))
        .union(edge(nation, key + 100, F.col("n_regionkey") + 1, name))
        .union(edge(nation, key + 1000, key + 100, F.concat(name, F.lit("-A"))))
        .union(edge(nation.where(key < 24), key + 1025, key + 100, F.concat(name, F.lit("-B"))))
    )


def product_position(spark: SparkSession, folder: str) -> DataFrame:
    """Every view is one observed search position."""
    product = F.col("user_id")
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "view")
        .select(
            F.col("ts").alias("timestamp"),
            product.alias("product_id"),
            (product * 10 + F.col("event_id") % 2).alias("sku_id"),
            _category_of(product).alias("category_id"),
            (1 + F.col("event_id") % 100).alias("position"),
        )
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is one payment."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("payment_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "F", "success").when(status == "O", "pending").otherwise("failed").alias(
            "status"
        ),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("subscription_type"),
        (F.col("o_orderkey") % 4).cast("int").alias("multiply"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def payment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Created payments and their later status changes.

    Pending payments change after a day, a third each to success, failed and
    unknown; half of the successes repeat, every tenth failure recovers and is
    then told twice. Some successes belong to no payment.
    """
    paid = payments(spark, folder)
    key = F.col("payment_id")
    created = paid.select(
        "payment_id",
        "user_id",
        F.lit("created").alias("kind"),
        F.col("created_at").alias("at"),
        "status",
        "subscription_type",
        "multiply",
    )

    def change(rows: DataFrame, days: int, status: F.Column, number: F.Column = key):
        return rows.select(
            number.alias("payment_id"),
            F.lit(None).cast("bigint").alias("user_id"),
            F.lit("status").alias("kind"),
            (F.col("created_at") + F.expr(f"INTERVAL {days} DAY")).alias("at"),
            status.alias("status"),
            F.lit(None).cast("int").alias("subscription_type"),
            F.lit(None).cast("int").alias("multiply"),
        )

    pending = paid.where(F.col("status") == "pending")
    third = F.when(key % 3 == 0, "success").when(key % 3 == 1, "failed").otherwise("unknown")
    success = F.lit("success")
    recovered = pending.where((key % 3 == 1) & (key % 10 == 0))
    return (
        created.union(change(pending, 1, third))
        .union(change(pending.where(key % 6 == 0), 2, success))
        .union(change(recovered, 3, success))
        .union(change(recovered, 4, success))
        .union(change(paid.where(key % 97 == 0), 0, success, key + 10**9))
    )


def report_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is one report request for a date range before it."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    to_date = F.date_sub(day, (key % 5).cast("int"))
    return table(spark, folder, "orders").select(
        key.alias("job_id"),
        (F.col("o_custkey") % 50).alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 2 == 0, "seller").otherwise("category").alias("report_type"),
        to_date.alias("to_date"),
        F.date_sub(to_date, (key % 130).cast("int")).alias("from_date"),
    )


def user_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer is one user; a fifth never had a plan."""
    key = F.col("c_custkey")
    plan = (
        F.when(key % 5 == 1, "demo")
        .when(key % 5 == 2, "default")
        .when(key % 5 == 3, "advanced")
        .when(key % 5 == 4, "pro")
    )
    end = F.when(key % 7 == 0, F.lit("1999-01-01")).otherwise(F.lit("2030-01-01"))
    return table(spark, folder, "customer").select(
        key.alias("user_id"),
        plan.alias("subscription_type"),
        end.cast("timestamp_ntz").alias("subscription_end_at"),
    )


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is one request with an API key."""
    return table(spark, folder, "events").select(
        "ts",
        (F.col("user_id") % 5).alias("api_key"),
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 8).cast("string")).alias("ip"),
        F.col("event_type").alias("browser"),
    )


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Scrape events as they arrive: products, positions, trees and noise.

    Every product event holds the SKU of its snapshot; every tenth holds a
    second one without full price and photo. Some product events are broken and
    some envelopes are of no known kind.
    """
    product = product_snapshot(spark, folder, numbered=True)
    text = F.col("purchase_price").cast("decimal(20,2)") / 100

    def pair(first: str, second: str, a: str, b: str) -> F.Column:
        return F.struct(F.lit(a).alias(first), F.lit(b).alias(second))

    def sku(number, full, photo):
        return F.struct(
            number.alias("sku_id"),
            text.cast("decimal(20,2)").cast("string").alias("purchase_price"),
            full.alias("full_price"),
            F.col("available_amount"),
            photo.alias("photo_key"),
            F.array(
                pair("type", "title", "color", "red"), pair("type", "title", "color", "blue")
            ).alias("characteristics"),
            F.col("restriction").alias("restricted_amount"),
        )

    full = (F.col("full_price").cast("decimal(20,2)") / 100).cast("decimal(20,2)")
    own = sku(F.col("sku_id"), F.coalesce(full.cast("string"), F.lit("")), F.col("photo_key"))
    extra = sku(F.col("product_id") * 10 + 2, F.lit(""), F.lit(""))
    body = F.struct(
        "product_id",
        "title",
        F.col("total_orders_amount").alias("orders"),
        "total_available_amount",
        "reviews_amount",
        "rating",
        "is_eco",
        "is_adult",
        F.array(F.lit("new")).alias("attributes"),
        F.array(F.lit("sale"), F.lit("top")).alias("tags"),
        F.struct(F.col("latest_category_id").alias("id")).alias("category"),
        F.struct(
            F.col("seller_id").alias("id"),
            F.col("seller_account_id").alias("account_id"),
            "seller_link",
            "seller_title",
            F.col("reviews_amount").alias("reviews"),
            F.col("total_orders_amount").alias("orders"),
            "rating",
            (F.datediff("seller_registration_date", F.lit("1970-01-01").cast("date")) * 86400)
            .cast("bigint")
            .alias("registration_seconds"),
            F.array(pair("type", "value", "mail", "a@b.c")).alias("contacts"),
        ).alias("seller"),
        F.when(F.col("event_id") % 10 == 0, F.array(own, extra))
        .otherwise(F.array(own))
        .alias("skus"),
    )
    position = product_position(spark, folder)
    events = table(spark, folder, "events")

    def envelope(rows, prefix, number, time, kind, payload):
        return rows.select(
            F.concat(F.lit(prefix), number.cast("string")).alias("event_id"),
            time.alias("scrap_time"),
            F.lit(kind).alias("kind"),
            payload.alias("payload"),
        )

    number, ts = F.col("event_id"), F.col("ts")
    timestamp = F.col("timestamp")
    broken = F.lit('{"product_id": ')
    place = F.to_json(F.struct("product_id", "sku_id", "category_id", "position"))
    return (
        envelope(product, "p", number, timestamp, "product", F.to_json(body))
        .union(envelope(position, "v", F.xxhash64("timestamp", "sku_id"), timestamp, "position", place))
        .union(envelope(events.where(number % 97 == 1), "b", number, ts, "product", broken))
        .union(envelope(events.where(number % 50 == 0), "h", number, ts, "heartbeat", F.lit("{}")))
        .union(category_envelopes(spark, folder))
    )


_ENVELOPES: dict[tuple[str, str], str] = {}

# Event files carry their times to the microsecond.
MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
# Event texts repeat their field names, so they are written compressed; such a
# file is read by one task, hence the bound on its rows.
PACKED = {"compression": "gzip", "maxRecordsPerFile": 100_000}


def stored_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The events as JSON files, written once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _ENVELOPES:
        path = fresh_folder(spark, "envelopes")
        envelopes(spark, folder).write.options(**MICROS, **PACKED).json(path)
        _ENVELOPES[key] = path
    return spark.read.schema(schemas.ENVELOPE).options(**MICROS).json(_ENVELOPES[key])


def category_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Each top category's tree in one event, and later again with new titles.

    The tree is a dimension of a few levels; a parent gathers its children.
    """
    edges = category_edges(spark, folder)

    def tree(suffix: str, time: str) -> DataFrame:
        named = edges.withColumn("title", F.concat("title", F.lit(suffix)))

        def level(low: int, high: int, children: DataFrame | None) -> DataFrame:
            rows = named.where(F.col("category_id").between(low, high))
            if children is None:
                return rows.select(
                    "parent_category_id",
                    F.struct("category_id", "title").alias("node"),
                    "category_id",
                )
            below = children.groupBy(F.col("parent_category_id").alias("category_id")).agg(
                F.sort_array(F.collect_list("node")).alias("children")
            )
            joined = rows.join(below, "category_id", "left")
            return joined.select(
                "parent_category_id",
                F.struct("category_id", "title", "children").alias("node"),
                "category_id",
            )

        top = level(1, 99, level(100, 999, level(1000, 9999, None)))
        return top.select(
            F.concat(F.lit(f"c{suffix}"), F.col("category_id").cast("string")).alias("event_id"),
            F.lit(time).cast("timestamp_ntz").alias("scrap_time"),
            F.lit("category").alias("kind"),
            F.to_json("node").alias("payload"),
        )

    return tree("", "2024-01-02 00:00:00").union(tree(" v2", "2024-01-20 00:00:00"))


def derived_market(spark: SparkSession, folder: str) -> Marketplace:
    """A marketplace computed from the given tables on every read."""
    return Marketplace(
        products=product_snapshot(spark, folder),
        categories=category_edges(spark, folder),
        positions=product_position(spark, folder),
    )


def stored_market(spark: SparkSession, folder: str) -> Marketplace:
    """A marketplace whose raw table and roll-up were written once per session.

    Queries read the stored tables, as they would in production: the raw table
    by month, the roll-up by month, the tree as it is.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MARKETS:
        raw_path = fresh_folder(spark, "products")
        append_series(
            product_snapshot(spark, folder), raw_path, ["product_id", "sku_id", "timestamp"]
        )
        raw = spark.read.parquet(raw_path)
        rollup_path = fresh_folder(spark, "rollup")
        append_series(
            rollup.observations(raw), rollup_path, ["product_id", "sku_id", "date"], "date"
        )
        _MARKETS[key] = Marketplace(
            products=raw,
            categories=category_edges(spark, folder),
            positions=product_position(spark, folder),
            partials=spark.read.parquet(rollup_path),
        )
    return _MARKETS[key]
