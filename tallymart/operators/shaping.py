"""Typed filters, dynamic sorting, paging and totals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators.skew import skew_join
from tallymart.session import shared_folder

from tallymart.sources.stores import stage


@dataclass(frozen=True)
class Equals:
    """Field equals a value."""

    field: str
    value: Any

    def condition(self) -> Column:
        return F.col(self.field) == F.lit(self.value)


@dataclass(frozen=True)
class Contains:
    """Field contains a text, ignoring case."""

    field: str
    text: str

    def condition(self) -> Column:
        return F.contains(F.lower(F.col(self.field)), F.lower(F.lit(self.text)))


@dataclass(frozen=True)
class Between:
    """Field lies between two numbers or two dates, both included."""

    field: str
    low: int | float | Decimal | dt.date
    high: int | float | Decimal | dt.date

    def condition(self) -> Column:
        return F.col(self.field).between(F.lit(self.low), F.lit(self.high))


@dataclass(frozen=True)
class SortBy:
    """One sort field; ascending unless said otherwise."""

    field: str
    descending: bool = False


def _known(table: DataFrame, field: str) -> None:
    if field not in table.columns:
        raise ValueError(f"Unknown field name: {field}")


def dynamic_filter(table: DataFrame, filters: Sequence[Equals | Contains | Between]):
    """Keep rows that pass every filter; fields are output column names."""
    for one in filters:
        _known(table, one.field)
        table = table.where(one.condition())
    return table


def sort_columns(
    table: DataFrame, sort: Sequence[SortBy], tie_break: Sequence[str]
) -> list[Column]:
    """Order columns for a validated sort, made total by ``tie_break``."""
    for one in sort:
        _known(table, one.field)
    named = [F.desc(s.field) if s.descending else F.asc(s.field) for s in sort]
    used = {s.field for s in sort}
    return [*named, *(F.asc(c) for c in tie_break if c not in used)]


def page(
    table: DataFrame,
    sort: Sequence[SortBy] = (),
    tie_break: Sequence[str] = ("product_id",),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order.

    A first page is a top-k, which keeps ``limit`` rows per task. Any page past
    the first is found by ``ranked``, so no offset gathers rows in one task.
    """
    if offset:
        return ranked(table, sort, tie_break, limit, offset)
    ordered = table.orderBy(*sort_columns(table, sort, tie_break))
    return ordered if limit is None else ordered.limit(limit)


def ranked(
    table: DataFrame,
    sort: Sequence[SortBy] = (),
    tie_break: Sequence[str] = ("product_id",),
    limit: int | None = None,
    offset: int = 0,
    position: str | None = None,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order, by distributed rank selection.

    The table is range-partitioned and sorted by the order and written once;
    rows are counted per partition (one small row each), the counts are summed
    up in order, and only the partitions that hold the page are read on, each
    row's rank being its partition's start plus its place in it. ``position``
    names an added column with the rank (from 0). The result is in page order;
    an empty table or a page past the end gives no rows.
    """
    spark = table.sparkSession
    shared_folder(spark)
    ordered = table.orderBy(*sort_columns(table, sort, tie_break)).checkpoint()
    part = F.spark_partition_id()
    counts = {
        row["part"]: row["rows"]
        for row in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()
    }
    starts, total = {}, 0
    for number in sorted(counts):
        starts[number], total = total, total + counts[number]
    end = total if limit is None else min(total, offset + limit)
    wanted = {number: at for number, at in starts.items() if at < end and at + counts[number] > offset}
    rank = "_rank" if position is None else position
    if not wanted:
        return ordered.limit(0).withColumn(rank, F.lit(0).cast("long")).drop(*([] if position else [rank]))
    first = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[part]
    # Within a partition the id counts rows in order from partition << 33.
    place = F.monotonically_increasing_id() - part.cast("long") * (1 << 33)
    rows = ordered.where(part.isin(list(wanted))).withColumn(rank, (first + place).cast("long"))
    chosen = rows.where((F.col(rank) >= offset) & (F.col(rank) < end)).orderBy(rank)
    return chosen if position else chosen.drop(rank)


def with_total(table: DataFrame, keys: Sequence[str] = (), out: str = "total") -> DataFrame:
    """Add the row count of the whole table or of each ``keys`` group.

    The total of the whole table is one row, so its join is a broadcast; a
    group's total is joined on its key by ``skew_join``, which spreads the rows
    of heavy keys and copies their totals, since adaptive execution does not
    split a join whose side is an aggregate. No window gathers a group in one
    task.
    """
    if not keys:
        return table.crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias(out))))
    totals = table.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return skew_join(table, totals, list(keys))


def staged_with_total(
    table: DataFrame, keys: Sequence[str], out: str = "total"
) -> DataFrame:
    """``with_total`` of a dear table, which is written once and then counted.

    Counting reads only the keys of what was written, so nothing that the table
    is made of is scanned or merged twice.
    """
    return with_total(stage(table, "counted"), keys, out)
