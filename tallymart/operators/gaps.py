"""Dense daily series from observed days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_spine(start: Column, end: Column) -> Column:
    """Every day from ``start`` up to but not including ``end``."""
    last = F.date_sub(end, 1)
    return F.when(start <= last, F.sequence(start, last)).otherwise(
        F.array().cast("array<date>")
    )


def _days(start: dt.date, end: dt.date) -> Column:
    return day_spine(F.lit(start), F.lit(end))


def fill_array(
    start: dt.date, end: dt.date, date: Column, value: Column, default: Column
) -> Column:
    """Aggregate: one entry per day of [start, end) plus observed days outside.

    A day is present once per group, so the group's map has at most one entry
    per calendar day.
    """
    seen = F.map_from_entries(F.collect_list(F.struct(date, value)))
    days = F.array_sort(F.array_union(_days(start, end), F.map_keys(seen)))
    return F.transform(days, lambda day: F.coalesce(F.try_element_at(seen, day), default))


def gap_fill(
    rows: DataFrame, keys: list[str], start: dt.date, end: dt.date, defaults: dict
) -> DataFrame:
    """Rows for every key and day of [start, end); missing days get ``defaults``.

    Observed days outside the range stay. One aggregation per key builds the
    series, so no second pass over the input is joined.
    """
    columns = list(defaults)
    seen = F.map_from_entries(
        F.collect_list(F.struct(F.col("date"), F.struct(*columns)))
    )
    series = rows.groupBy(*keys).agg(seen.alias("_seen"))
    days = F.array_sort(F.array_union(_days(start, end), F.map_keys("_seen")))
    filled = series.select(*keys, F.explode(days).alias("date"), "_seen").select(
        *keys, "date", F.try_element_at("_seen", F.col("date")).alias("_row")
    )
    types = {field.name: field.dataType for field in rows.schema.fields}
    return filled.select(
        *keys,
        "date",
        *(
            F.when(F.col("_row").isNull(), F.lit(defaults[c]).cast(types[c]))
            .otherwise(F.col("_row")[c])
            .alias(c)
            for c in columns
        ),
    )


def gap_fill_carry(
    rows: DataFrame,
    keys: list[str],
    start: dt.date,
    end: dt.date,
    carry: list[str],
    defaults: dict,
) -> DataFrame:
    """As ``gap_fill``, but ``carry`` columns repeat the last observed value.

    Days before a key's first observation are dropped.
    """
    marked = rows.withColumn("_observed", F.lit(True))
    dense = gap_fill(
        marked, keys, start, end, {**defaults, **dict.fromkeys([*carry, "_observed"])}
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = {c: F.last(c, ignorenulls=True).over(upto) for c in [*carry, "_observed"]}
    return dense.withColumns(carried).where("_observed").drop("_observed")
