"""Running sums of long series in two steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    rows: DataFrame,
    keys: list[str],
    bucket: Column,
    order: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Add ``<value>_upto``: the sum over a key's rows up to and with this one.

    ``bucket`` must grow with ``order``, such as the hour of a timestamp. Bucket
    totals are accumulated per key, rows only within their bucket, so the rows
    of one busy key are spread over as many tasks as it has buckets.
    """
    cut = rows.withColumn("_bucket", bucket)
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        cut.groupBy(*keys, "_bucket")
        .agg(*(F.sum(v).alias(f"_{v}") for v in values))
        .select(
            *keys,
            "_bucket",
            *(
                F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_start")
                for v in values
            ),
        )
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return cut.join(starts, [*keys, "_bucket"]).select(
        *rows.columns,
        *((F.col(f"_{v}_start") + F.sum(v).over(within)).alias(f"{v}_upto") for v in values),
    )
