"""Exact order statistics of groups too large for one task.

A window over a whole group would sort that group in one task. Here every
group is first cut into value buckets; only the bucket totals (a few thousand
at most, whatever the group's size) are accumulated per group, and the rows are
ordered inside one bucket each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 32


def value_bucket(value: Column) -> Column:
    """A bucket number that never decreases as ``value`` grows."""
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1) * BUCKETS_PER_DOUBLING)
    return F.when(value < 0, -size).otherwise(size).cast("int")


def grouped_median(
    rows: DataFrame, keys: list[str], value: str, out: str, weight: Column | None = None
) -> DataFrame:
    """Interpolated median of ``value`` per ``keys``, NULL values left out."""
    counted = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    buckets = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_bucket_n"))
        .withColumn("_start", F.sum("_bucket_n").over(upto) - F.col("_bucket_n"))
        .withColumn("_total", F.sum("_bucket_n").over(group))
        .withColumn("_low", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_high", F.floor(F.col("_total") / 2))
        .where(
            (F.col("_start") <= F.col("_high"))
            & (F.col("_start") + F.col("_bucket_n") > F.col("_low"))
        )
        .select(*keys, "_bucket", "_start", "_low", "_high")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.join(buckets, [*keys, "_bucket"]).withColumn(
        "_upto", F.col("_start") + F.sum("_n").over(inside)
    )
    from_ = F.col("_upto") - F.col("_n")

    def at(rank: str) -> Column:
        hit = (from_ <= F.col(rank)) & (F.col(rank) < F.col("_upto"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    return ranked.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias(out))


def running_above(
    rows: DataFrame, keys: list[str], value: str
) -> DataFrame:
    """Per distinct ``value`` of a group: the sum of all greater values.

    Returns ``keys``, ``value``, ``above`` and the group's ``total``.
    """
    distinct = (
        rows.groupBy(*keys, value)
        .agg(F.sum(value).alias("_mass"))
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    group = Window.partitionBy(*keys)
    down = group.orderBy(F.desc("_bucket")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    buckets = (
        distinct.groupBy(*keys, "_bucket")
        .agg(F.sum("_mass").alias("_bucket_mass"))
        .withColumn("_start", F.sum("_bucket_mass").over(down) - F.col("_bucket_mass"))
        .withColumn("total", F.sum("_bucket_mass").over(group))
        .select(*keys, "_bucket", "_start", "total")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.desc(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    above = F.col("_start") + F.sum("_mass").over(inside) - F.col("_mass")
    return distinct.join(buckets, [*keys, "_bucket"]).select(
        *keys, value, above.alias("above"), "total"
    )
