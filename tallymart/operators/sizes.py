"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000


def sized_broadcast(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if it has at most ``max_rows`` rows.

    Beyond that the table is returned as it is: the join shuffles, and adaptive
    execution splits skewed keys. The count stops at the bound.
    """
    if table.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(table)
    return table
