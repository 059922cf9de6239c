"""Event envelopes and the rows inside them; the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart import schemas
from tallymart.functions.maps import last_wins_map
from tallymart.functions.numbers import price_to_minor, unreadable_price

# The kinds of events handled, each with the id its payload must have.
KINDS = {"product": "product_id", "position": "product_id", "category": "category_id"}
QUARANTINE = "quarantine"
NO_ID, BAD_SHAPE, BAD_PRICE = "no_id", "bad_shape", "bad_price"


def read_stream(
    spark: SparkSession, path: str, schema: str = schemas.ENVELOPE, files: int | None = None
) -> DataFrame:
    """New JSON files of a folder as a stream, optionally few per batch."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.json(path)


def _id(kind: str) -> Column:
    return F.from_json("payload", f"{KINDS[kind]} bigint")[KINDS[kind]]


def _product_fault(p: Column) -> Column:
    """Why a parsed product event cannot become rows, or NULL."""
    skus = p["skus"]
    shapeless = skus.isNull() | (F.size(skus) == 0) | F.exists(skus, lambda sku: sku["sku_id"].isNull())
    priceless = F.exists(
        skus,
        lambda sku: unreadable_price(sku["full_price"]) | unreadable_price(sku["purchase_price"]),
    )
    return (
        F.when(p["product_id"].isNull(), NO_ID).when(shapeless, BAD_SHAPE).when(priceless, BAD_PRICE)
    )


def fault(kind: Column, payload: Column) -> Column:
    """Why an event is not readable, or NULL; its payload is parsed once."""
    reason = F.when(
        kind == "product", _product_fault(F.from_json(payload, schemas.PRODUCT_PAYLOAD))
    )
    for other in KINDS:
        if other != "product":
            reason = reason.when((kind == other) & _id(other).isNull(), NO_ID)
    return reason


def routed(envelopes: DataFrame) -> DataFrame:
    """Add ``target``, the kind or quarantine, and ``reason`` for the latter.

    Envelopes of other kinds are dropped; of the rest none is lost.
    """
    known = envelopes.where(F.col("kind").isin(*KINDS))
    known = known.withColumn("reason", fault(F.col("kind"), F.col("payload")))
    return known.withColumn(
        "target", F.when(F.col("reason").isNotNull(), QUARANTINE).otherwise(F.col("kind"))
    )


def of_kind(envelopes: DataFrame, kind: str) -> DataFrame:
    """Readable envelopes of one kind other than products."""
    return envelopes.where((F.col("kind") == kind) & _id(kind).isNotNull())


def product_rows(envelopes: DataFrame) -> DataFrame:
    """One raw snapshot row per SKU of every product event."""
    events = (
        envelopes.where(F.col("kind") == "product")
        .select("scrap_time", F.from_json("payload", schemas.PRODUCT_PAYLOAD).alias("p"))
        .where(_product_fault(F.col("p")).isNull())
    )
    rows = events.select("scrap_time", "p", F.explode("p.skus").alias("sku"))
    p, sku, seller = F.col("p"), F.col("sku"), F.col("p.seller")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    registered = epoch + F.make_dt_interval(secs=seller["registration_seconds"])
    return rows.select(
        F.col("scrap_time").alias("timestamp"),
        p["product_id"].alias("product_id"),
        sku["sku_id"].alias("sku_id"),
        p["title"].alias("title"),
        p["rating"].alias("rating"),
        p["category"]["id"].alias("latest_category_id"),
        p["reviews_amount"].alias("reviews_amount"),
        p["orders"].alias("total_orders_amount"),
        p["total_available_amount"].alias("total_available_amount"),
        sku["available_amount"].alias("available_amount"),
        p["attributes"].alias("attributes"),
        p["tags"].alias("tags"),
        F.nullif(sku["photo_key"], F.lit("")).alias("photo_key"),
        last_wins_map(sku["characteristics"], "type", "title").alias("characteristics"),
        seller["id"].alias("seller_id"),
        seller["account_id"].alias("seller_account_id"),
        seller["seller_title"].alias("seller_title"),
        seller["seller_link"].alias("seller_link"),
        registered.alias("seller_registration_date"),
        seller["rating"].alias("seller_rating"),
        seller["reviews"].alias("seller_reviews_count"),
        seller["orders"].alias("seller_orders"),
        last_wins_map(seller["contacts"], "type", "value").alias("seller_contacts"),
        p["is_eco"].alias("is_eco"),
        p["is_adult"].alias("is_adult"),
        price_to_minor(sku["full_price"]).alias("full_price"),
        price_to_minor(sku["purchase_price"]).alias("purchase_price"),
        F.coalesce(sku["restricted_amount"], F.lit(0).cast("smallint")).alias("restriction"),
    )


def position_rows(envelopes: DataFrame) -> DataFrame:
    """One row per observed position."""
    body = F.from_json("payload", schemas.POSITION_PAYLOAD).alias("p")
    return of_kind(envelopes, "position").select("scrap_time", body).select(
        F.col("scrap_time").alias("timestamp"), "p.*"
    )


def category_rows(envelopes: DataFrame) -> DataFrame:
    """Edges of every category tree, with the event time as version.

    Children stay JSON text until their level is reached, so a tree may be of
    any depth; the loop ends at the first empty level. Not for use on a stream
    itself but within ``foreachBatch``.
    """

    def parsed(level: DataFrame) -> DataFrame:
        return level.select(
            "version", "parent", F.from_json("node", schemas.CATEGORY_PAYLOAD).alias("node")
        ).where(F.col("node.category_id").isNotNull())

    level = parsed(
        of_kind(envelopes, "category").select(
            F.col("scrap_time").alias("version"),
            F.lit(0).cast("bigint").alias("parent"),
            F.col("payload").alias("node"),
        )
    )
    edges = None
    while edges is None or not level.isEmpty():
        found = level.select(
            F.col("node.category_id").alias("category_id"),
            F.col("parent").alias("parent_category_id"),
            F.col("node.title").alias("title"),
            "version",
        )
        edges = found if edges is None else edges.unionByName(found)
        level = parsed(
            level.select(
                "version",
                F.col("node.category_id").alias("parent"),
                F.explode("node.children").alias("node"),
            )
        )
    return edges
