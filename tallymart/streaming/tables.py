"""Incremental tables fed by streams, each safe to replay.

Raw rows go through the file sink, which commits every batch once. Tables built
in ``foreachBatch`` keep their batch number as a partition and overwrite just
that, so a repeated batch replaces itself. One table belongs to one checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymart.plans import rollup
from tallymart.sources import upserts
from tallymart.streaming import envelopes as env


def append_rows(
    rows: DataFrame, path: str, checkpoint: str, month_of: str | None = None
) -> StreamingQuery:
    """Append a stream to a table, by month of ``month_of`` if given."""
    if month_of:
        rows = rows.withColumn("month", F.date_format(month_of, "yyyyMM").cast("int"))
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if month_of:
        writer = writer.partitionBy("month")
    return writer.trigger(availableNow=True).start(path)


def replace_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Write one batch, replacing an earlier try of the same batch."""
    (
        rows.withColumn("batch_id", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def for_each_batch(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Keep ``transform`` of every batch as one replaceable partition."""

    def write(batch: DataFrame, number: int) -> None:
        replace_batch(transform(batch), number, path)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_products(envelopes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append one raw row per SKU."""
    return append_rows(env.product_rows(envelopes), path, checkpoint, "timestamp")


def stream_positions(envelopes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append observed positions."""
    return append_rows(env.position_rows(envelopes), path, checkpoint, "timestamp")


def stream_rollup(envelopes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append roll-up observations of each batch; late rows join their own day."""

    def collapse(batch: DataFrame) -> DataFrame:
        return rollup.observations(env.product_rows(batch))

    return for_each_batch(envelopes, collapse, path, checkpoint)


def stream_categories(envelopes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the edges of each batch's category trees as versions."""
    return for_each_batch(envelopes, env.category_rows, path, checkpoint)


def stream_sellers(envelopes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's distinct sellers as versions."""

    def sellers(batch: DataFrame) -> DataFrame:
        return upserts.sellers_of(env.product_rows(batch))

    return for_each_batch(envelopes, sellers, path, checkpoint)


def partials(spark: SparkSession, path: str) -> DataFrame:
    """All roll-up observations written so far."""
    return spark.read.parquet(path).drop("batch_id")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Merge the observations of many batches into a new table by month."""
    merged = rollup.merge(partials(spark, path))
    (
        merged.withColumn("month", F.date_format("date", "yyyyMM").cast("int"))
        .sortWithinPartitions("month", "product_id", "sku_id", "date")
        .write.partitionBy("month")
        .parquet(target)
    )


def current_versions(
    spark: SparkSession, path: str, key: list[str], version: str
) -> DataFrame:
    """The newest version of every key among all batches."""
    changes = spark.read.parquet(path).drop("batch_id")
    return upserts.latest_wins(changes, key, version)
