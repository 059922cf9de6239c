"""Maps from lists of pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_wins_map(pairs: Column, key: str, value: str) -> Column:
    """Map of the pairs; of equal keys the last one counts.

    Independent of the session's policy for duplicate map keys.
    """
    keys = F.array_distinct(F.transform(pairs, lambda pair: pair[key]))
    values = F.transform(
        keys,
        lambda k: F.element_at(F.filter(pairs, lambda pair: pair[key] == k), -1)[value],
    )
    return F.map_from_arrays(keys, values)
