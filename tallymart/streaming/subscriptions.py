"""Subscriptions from payment events, in batch and on a stream.

A payment grants days when it becomes successful. Grants of a user follow each
other: a grant at ``t`` extends the end if it lies ahead, else starts at ``t``.
With ``S`` the days granted so far, the end after grant ``k`` is
``S_k + max(t_j - S_(j-1))`` over all grants ``j`` up to ``k``. The pair of the
total and that maximum merges, so a user's state is two numbers per batch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymart.operators.running import running_sums
from tallymart.sources.files import Store
from tallymart.sources.stores import stage
from tallymart.streaming.tables import replace_batch

# Days one payment unit buys, and days of a demo.
UNIT_DAYS = 30
DEMO_DAYS = 3
DEMO = "demo"
# Plan number of a payment to plan name.
PLAN_NAMES = {1: "default", 2: "advanced", 3: "pro"}
SUCCESS = "success"
UNKNOWN = "unknown"
CARRIED = "carried"  # kind of the pseudo event that brings an earlier status

GRANT = "payment_id bigint, user_id bigint, at timestamp_ntz, days int, plan int"
EVENT_FIELDS = [
    "payment_id",
    "user_id",
    "kind",
    "at",
    "status",
    "subscription_type",
    "multiply",
]
EVENT = (
    "payment_id bigint, user_id bigint, kind string, at timestamp_ntz, status string, "
    "subscription_type int, multiply int"
)
CARRIED_FROM = dt.datetime(1, 1, 1)  # before any event
STATE = (
    "payment_id bigint, status string, user_id bigint, subscription_type int, "
    "multiply int, batch_id int"
)
ORPHANS = f"{EVENT}, batch_id int"
#: Hash buckets of payments in the state tables; a batch reads the buckets it touches.
BUCKETS = 64
#: Runs of batches a bucket may hold before they are merged into one.
RUNS = 4


def bucket_of(payment: Column) -> Column:
    return F.pmod(F.xxhash64(payment), F.lit(BUCKETS)).cast("int")


def replace_bucketed(rows: DataFrame, batch: int, path: str) -> None:
    """Write one batch by (bucket, batch_id), replacing an earlier try of the same batch."""
    (
        rows.withColumns({"bucket": bucket_of(F.col("payment_id")), "batch_id": F.lit(batch)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch_id")
        .parquet(path)
    )


def read_buckets(spark, path: str, schema: str, buckets: list[int], before: int) -> DataFrame:
    """Rows of earlier batches in the given buckets only; other buckets' folders are not read."""
    store = Store(spark, path)
    folders = [store.path(f"bucket={k}") for k in buckets if store.names(f"bucket={k}")]
    if not folders:
        return spark.createDataFrame([], f"{schema}, bucket int")
    table = spark.read.schema(f"{schema}, bucket int").option("basePath", path).parquet(*folders)
    return table.where(F.col("batch_id") < before)


def compact_states(spark, path: str, buckets: list[int], number: int) -> int:
    """Merge the runs of earlier batches of crowded buckets into one; how many buckets.

    A bucket holding ``RUNS`` or more runs before ``number`` gets one run of
    batch ``number - 1`` with the newest state of each payment, written aside
    first and then over that run; the older runs go after it. A replay of batch
    ``number`` reads the same newest states as before, and a bucket's reads stay
    bounded however many batches went before.
    """
    store = Store(spark, path)
    crowded = []
    for k in buckets:
        runs = [int(name.split("=", 1)[1]) for name in store.names(f"bucket={k}") if name.startswith("batch_id=")]
        if len([b for b in runs if b < number]) >= RUNS:
            crowded.append(k)
    if not crowded:
        return 0
    fields = ["status", "user_id", "subscription_type", "multiply"]
    old = read_buckets(spark, path, STATE, crowded, number)
    newest = old.groupBy("payment_id").agg(F.max(F.struct("batch_id", *fields)).alias("_s")).select(
        "payment_id", *(F.col(f"_s.{c}").alias(c) for c in fields)
    )
    replace_bucketed(stage(newest, "payment-runs"), number - 1, path)
    for k in crowded:
        for name in store.names(f"bucket={k}"):
            if name.startswith("batch_id=") and int(name.split("=", 1)[1]) < number - 1:
                store.remove(f"bucket={k}", name)
    return len(crowded)


def granted_days(multiply: Column) -> Column:
    units = F.when(multiply > 1, multiply).otherwise(F.lit(1))
    return (units * UNIT_DAYS).cast("int")


def _days(count: Column) -> Column:
    return F.make_dt_interval(count.cast("int"))


def known_events(events: DataFrame) -> DataFrame:
    """Events that may change a payment: unknown statuses are ignored."""
    return events.where((F.col("kind") != "status") | (F.col("status") != UNKNOWN))


def sequenced(events: DataFrame) -> DataFrame:
    """Events of each payment from its creation on, with the status before.

    Columns ``before`` and ``orphan`` tell the earlier status and whether the
    payment was unknown at that time. A second creation is ignored. A payment
    has a handful of events.
    """
    created = F.col("kind") != "status"
    rank = F.when(created, 0).otherwise(1)
    upto = (
        Window.partitionBy("payment_id")
        .orderBy("at", rank, "status")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    origin = F.when(created, F.struct("user_id", "subscription_type", "multiply"))
    marked = known_events(events).withColumns(
        {
            "_origin": F.first(origin, ignorenulls=True).over(upto),
            "_creations": F.count(origin).over(upto),
        }
    )
    kept = marked.withColumn("orphan", F.col("_origin").isNull()).where(
        ~created | (F.col("_creations") == 1)
    )
    chain = Window.partitionBy("payment_id", "orphan").orderBy("at", rank, "status")
    return kept.withColumn("before", F.lag("status").over(chain))


def grants(events: DataFrame) -> DataFrame:
    """One row each time a payment becomes successful."""
    return _grants(sequenced(events))


def _grants(chained: DataFrame) -> DataFrame:
    won = (F.col("status") == SUCCESS) & (
        F.col("before").isNull() | (F.col("before") != SUCCESS)
    )
    return chained.where(~F.col("orphan") & won & (F.col("kind") != CARRIED)).select(
        "payment_id",
        F.col("_origin.user_id").alias("user_id"),
        "at",
        granted_days(F.col("_origin.multiply")).alias("days"),
        F.col("_origin.subscription_type").alias("plan"),
    )


def orphans(events: DataFrame) -> DataFrame:
    """Successes of payments unknown at that time, for the quarantine."""
    return sequenced(events).where(F.col("orphan") & (F.col("status") == SUCCESS)).select(
        "payment_id", "at", "status"
    )


def user_states(granted: DataFrame) -> DataFrame:
    """Total days, the maximum above and the latest grant per user."""
    day = F.date_trunc("day", "at")
    summed = running_sums(granted, ["user_id"], day, ["at", "payment_id"], ["days"])
    lead = F.col("at") - _days(F.col("days_upto") - F.col("days"))
    return summed.withColumn("_lead", lead).groupBy("user_id").agg(
        F.sum("days").alias("days"),
        F.max("_lead").alias("lead"),
        F.max(F.struct("at", "payment_id", "plan")).alias("latest"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Merge the states of consecutive batches, ordered by ``batch_id``."""
    before = (
        Window.partitionBy("user_id")
        .orderBy("batch_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("days").over(before), F.lit(0))
    return states.withColumn("lead", F.col("lead") - _days(shift)).groupBy("user_id").agg(
        F.sum("days").alias("days"),
        F.max("lead").alias("lead"),
        F.max_by("latest", "batch_id").alias("latest"),
    )


def subscriptions(states: DataFrame) -> DataFrame:
    """Plan, start of the latest grant and end of the subscription per user."""
    plan = F.lit(None).cast("string")
    for number, name in PLAN_NAMES.items():
        plan = F.when(F.col("latest.plan") == number, name).otherwise(plan)
    return states.select(
        "user_id",
        plan.alias("subscription_type"),
        F.col("latest.at").alias("subscription_created_at"),
        (F.col("lead") + _days(F.col("days"))).alias("subscription_end_at"),
    )


def subscription_state(events: DataFrame) -> DataFrame:
    """Subscription of every user after all payment events."""
    return subscriptions(user_states(grants(events)))


def demo_grants(asking: DataFrame, subscribed: DataFrame, at: Column) -> DataFrame:
    """A demo for every asking user who never had a plan."""
    fresh = asking.where(F.col("subscription_type").isNull()).select("user_id").distinct()
    return fresh.join(subscribed.select("user_id"), "user_id", "left_anti").select(
        "user_id",
        F.lit(DEMO).alias("subscription_type"),
        at.alias("subscription_created_at"),
        (at + F.expr(f"INTERVAL {DEMO_DAYS} DAY")).alias("subscription_end_at"),
    )


def carried(states: DataFrame, before_batch: int, events: DataFrame) -> DataFrame:
    """The standing of the events' payments before a batch, as events.

    ``states`` has one row per payment and batch that touched it; only payments
    of this batch are kept before the newest row of each is taken.
    """
    touched = events.select("payment_id").distinct()
    fields = ["user_id", "status", "subscription_type", "multiply"]
    newest = (
        states.where(F.col("batch_id") < before_batch)
        .join(touched, "payment_id", "left_semi")
        .groupBy("payment_id")
        .agg(F.max(F.struct("batch_id", *fields)).alias("_state"))
    )
    return newest.select(
        "payment_id",
        F.col("_state.user_id").alias("user_id"),
        F.lit(CARRIED).alias("kind"),
        F.lit(CARRIED_FROM).cast("timestamp_ntz").alias("at"),
        F.col("_state.status").alias("status"),
        F.col("_state.subscription_type").alias("subscription_type"),
        F.col("_state.multiply").alias("multiply"),
    )


def payment_states(chained: DataFrame) -> DataFrame:
    """Newest status of every known payment of a batch."""
    order = F.struct("at", F.when(F.col("kind") != "status", 0).otherwise(1), "status")
    return (
        chained.where(~F.col("orphan"))
        .groupBy("payment_id")
        .agg(
            F.max(F.struct(order.alias("order"), "_origin")).alias("_last"),
        )
        .select(
            "payment_id",
            F.col("_last.order.status").alias("status"),
            F.col("_last._origin.user_id").alias("user_id"),
            F.col("_last._origin.subscription_type").alias("subscription_type"),
            F.col("_last._origin.multiply").alias("multiply"),
        )
    )


def stream_payments(
    events: DataFrame, states_path: str, grants_path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the status of every payment and the grants of each batch.

    A batch starts from the states earlier batches left, so a repeated batch
    reads the same states and replaces its own rows. States and waiting rows are
    kept by (bucket, batch) of the payment's hash; a batch lists and reads only
    the buckets its payments fall in, and crowded buckets are compacted, so what
    a batch reads does not grow with the number of batches before it. Everything is a join and a
    window over the payments of the batch, however many they are. Statuses of
    unknown payments wait in a table beside the states, by batch, and are told
    again with their payment's creation, as if they had come in order; successes
    that stay there are the quarantine.
    """

    waiting_path = f"{states_path}-waiting"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = stage(batch.select(*EVENT_FIELDS), "payment-batch")
        # The buckets this batch touches: at most BUCKETS numbers.
        touched = [row["bucket"] for row in known.select(bucket_of(F.col("payment_id")).alias("bucket")).distinct().collect()]
        if number > 0:
            waiting = read_buckets(spark, waiting_path, ORPHANS, touched, number)
            created = known.where(F.col("kind") != "status").select("payment_id").distinct()
            late = waiting.join(created, "payment_id", "left_semi").select(*EVENT_FIELDS)
            states = read_buckets(spark, states_path, STATE, touched, number)
            known = known.unionByName(late).unionByName(carried(states, number, known))
        # Written once: the tables that it reads change below.
        chained = stage(sequenced(known), "payments")
        replace_batch(_grants(chained), number, grants_path)
        replace_bucketed(payment_states(chained), number, states_path)
        orphaned = chained.where(F.col("orphan") & (F.col("kind") == "status"))
        replace_bucketed(orphaned.select(*EVENT_FIELDS), number, waiting_path)
        compact_states(spark, states_path, touched, number)

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
