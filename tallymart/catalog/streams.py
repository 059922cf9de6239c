"""Streaming queries by name.

Each writes its events in two deliveries and runs the stream after either, so
that the second run continues from the checkpoint of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymart import schemas
from tallymart.plans import rollup
from tallymart.session import fresh_folder
from tallymart.sources import sample, stores, upserts
from tallymart.streaming import envelopes as env
from tallymart.streaming import key_sharing, lsm, subscriptions, tables

MIDDLE = "2024-01-15"
VISIT = "ts timestamp_ntz, api_key bigint, ip string, browser string"

Start = Callable[[DataFrame, str, str], StreamingQuery]


def deliveries(events: DataFrame, time: str, middle: str) -> list[DataFrame]:
    """Events before and from ``middle`` on."""
    cut = F.lit(middle).cast("timestamp_ntz")
    return [events.where(F.col(time) < cut), events.where(F.col(time) >= cut)]


def run(
    spark: SparkSession, parts: list[DataFrame], kind: str, schema: str, start: Start
) -> str:
    """Deliver each part as files and drain the stream; return the table's path."""
    source, target, checkpoint = (
        fresh_folder(spark, name) for name in ("events", "stream", "checkpoint")
    )
    packed = sample.PACKED if kind == "json" else {}
    for part in parts:
        part.write.mode("append").format(kind).options(**sample.MICROS, **packed).save(source)
        stream = spark.readStream.schema(schema).format(kind).options(**sample.MICROS).load(source)
        start(stream, target, checkpoint).awaitTermination()
    return target


def _envelopes(spark: SparkSession, folder: str, start: Start) -> str:
    parts = deliveries(sample.stored_envelopes(spark, folder), "scrap_time", MIDDLE)
    return run(spark, parts, "json", schemas.ENVELOPE, start)


def route_events(spark, folder):
    """Events per target and day."""

    def start(stream, path, checkpoint):
        return tables.append_rows(env.routed(stream), path, checkpoint)

    rows = spark.read.parquet(_envelopes(spark, folder, start))
    return rows.groupBy("target", F.to_date("scrap_time").alias("date")).agg(
        F.count(F.lit(1)).alias("events")
    )


SNAPSHOT_COLUMNS = [
    "timestamp",
    "product_id",
    "sku_id",
    "title",
    "rating",
    "latest_category_id",
    "reviews_amount",
    "total_orders_amount",
    "total_available_amount",
    "available_amount",
    "photo_key",
    "seller_id",
    "seller_account_id",
    "seller_title",
    "seller_link",
    "seller_registration_date",
    "is_eco",
    "is_adult",
    "full_price",
    "purchase_price",
    "restriction",
]


def _flat_products(rows: DataFrame) -> DataFrame:
    return rows.select(
        *SNAPSHOT_COLUMNS,
        F.col("characteristics")["color"].alias("color"),
        F.array_join("tags", ",").alias("tags"),
    )


def stream_products(spark, folder):
    return _flat_products(
        spark.read.parquet(_envelopes(spark, folder, tables.stream_products))
    )


def ingest_products(spark, folder):
    """The same events decoded and appended in one batch."""
    path = fresh_folder(spark, "ingest")
    rows = env.product_rows(sample.stored_envelopes(spark, folder))
    stores.append_series(rows, path, ["product_id", "sku_id", "timestamp"])
    return _flat_products(spark.read.parquet(path))


POSITION_COLUMNS = ["timestamp", "product_id", "sku_id", "category_id", "position"]


def stream_positions(spark, folder):
    path = _envelopes(spark, folder, tables.stream_positions)
    return spark.read.parquet(path).select(*POSITION_COLUMNS)


def ingest_positions(spark, folder):
    path = fresh_folder(spark, "ingest")
    rows = env.position_rows(sample.stored_envelopes(spark, folder))
    stores.append_series(rows, path, ["category_id", "product_id", "sku_id", "timestamp"])
    return spark.read.parquet(path).select(*POSITION_COLUMNS)


def day_slices(events: DataFrame, time: str, parts: int) -> list[DataFrame]:
    """Events in ``parts`` slices of days; the first slice comes last, as late rows."""
    day = F.dayofmonth(F.col(time))
    slices = [events.where((day - 1) % parts == k) for k in range(parts)]
    return slices[1:] + slices[:1]


def stream_daily_rollup(spark, folder):
    """The roll-up fed batch by batch into the log-structured table, compacted mid-stream."""
    parts = day_slices(sample.stored_envelopes(spark, folder), "scrap_time", 2 * lsm.FANOUT)
    root = run(spark, parts, "json", schemas.ENVELOPE, lsm.stream_rollup)
    return rollup.daily_sales(rollup.sku_days(lsm.read(spark, root)))


def stream_categories(spark, folder):
    path = _envelopes(spark, folder, tables.stream_categories)
    return tables.current_versions(spark, path, upserts.CATEGORY_KEY, "version")


def stream_sellers(spark, folder):
    path = _envelopes(spark, folder, tables.stream_sellers)
    return tables.current_versions(spark, path, upserts.SELLER_KEY, "seen_at")


def subscription_state(spark, folder):
    return subscriptions.subscription_state(sample.payment_events(spark, folder))


def quarantine_events(spark, folder):
    """Unreadable events by reason and day, some made so for the trial."""
    known = sample.stored_envelopes(spark, folder)
    number = F.substring("event_id", 2, 30).try_cast("bigint")
    product = F.col("event_id").startswith("p")
    priceless = F.regexp_replace("payload", '"purchase_price":"[^"]*"', '"purchase_price":"abc"')
    shapeless = F.regexp_replace("payload", '"skus":', '"goods":')
    payload = (
        F.when(product & (number % 97 == 2), priceless)
        .when(product & (number % 97 == 3), shapeless)
        .otherwise(F.col("payload"))
    )

    def start(stream, path, checkpoint):
        return tables.append_rows(env.routed(stream), path, checkpoint)

    parts = deliveries(known.withColumn("payload", payload), "scrap_time", MIDDLE)
    rows = spark.read.parquet(run(spark, parts, "json", schemas.ENVELOPE, start))
    return (
        rows.where(F.col("target") == env.QUARANTINE)
        .groupBy("reason", F.to_date("scrap_time").alias("date"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


def payment_stream_late(spark, folder):
    """As ``stream_subscriptions``, with every status delivered before its payment."""
    events = sample.payment_events(spark, folder)
    status = F.col("kind") == "status"
    return _streamed_payments(spark, [events.where(status), events.where(~status)])


def stream_subscriptions(spark, folder):
    """Payments kept as a state table, users as mergeable states."""
    parts = deliveries(sample.payment_events(spark, folder), "at", "1995-06-17")
    return _streamed_payments(spark, parts)


def _streamed_payments(spark, parts):
    grants = fresh_folder(spark, "grants")

    def start_payments(stream, path, checkpoint):
        return subscriptions.stream_payments(stream, path, grants, checkpoint)

    run(spark, parts, "parquet", subscriptions.EVENT, start_payments)
    granted = spark.read.parquet(grants).drop("batch_id")

    def start_states(stream, path, checkpoint):
        return tables.for_each_batch(stream, subscriptions.user_states, path, checkpoint)

    halves = deliveries(granted, "at", "1995-06-17")
    states = run(spark, halves, "parquet", subscriptions.GRANT, start_states)
    return subscriptions.subscriptions(
        subscriptions.merge_states(spark.read.parquet(states))
    )


def payment_orphans(spark, folder):
    return subscriptions.orphans(sample.payment_events(spark, folder))


def demo_grant(spark, folder):
    users = sample.user_plans(spark, folder)
    subscribed = subscription_state(spark, folder)
    return subscriptions.demo_grants(users, subscribed, F.lit(sample.AS_OF).cast("timestamp_ntz"))


def key_sharing_detector(spark, folder):
    parts = deliveries(sample.access_log(spark, folder), "ts", MIDDLE)

    def start_once(stream, path, checkpoint):
        return tables.for_each_batch(stream, key_sharing.once_per_second, path, checkpoint)

    once = spark.read.parquet(run(spark, parts, "parquet", VISIT, start_once)).drop("batch_id")

    def start_alarms(stream, path, checkpoint):
        return tables.append_rows(key_sharing.stream_alarms_in_store(stream), path, checkpoint)

    halves = deliveries(once, "ts", MIDDLE)
    # The state store of this query is RocksDB; other queries keep the session's.
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    try:
        path = run(spark, halves, "parquet", VISIT, start_alarms)
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.parquet(path)


QUERIES = {
    "route_events": route_events,
    "stream_products": stream_products,
    "ingest_products": ingest_products,
    "stream_positions": stream_positions,
    "ingest_positions": ingest_positions,
    "stream_daily_rollup": stream_daily_rollup,
    "stream_categories": stream_categories,
    "stream_sellers": stream_sellers,
    "subscription_state": subscription_state,
    "stream_subscriptions": stream_subscriptions,
    "payment_stream_late": payment_stream_late,
    "quarantine_events": quarantine_events,
    "payment_orphans": payment_orphans,
    "demo_grant": demo_grant,
    "key_sharing_detector": key_sharing_detector,
}
