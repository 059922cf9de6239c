"""Joins that stay even when a few keys hold much of a table.

Heavy keys are found by Spark's frequent-items summary, which each task builds
over its rows and which merge into one: a key above the support may be listed,
one below it never costs more than an ordinary key. Rows of the large side with
a heavy key are spread over ``salts`` buckets by their place in their task, so
copies of one row spread too and a recomputed task deals its rows alike; the rows of the
small side with that key are copied once per bucket, so every pair still meets
exactly once. Rows with other keys join as they would anyway. The result is
that of the plain join, whatever the salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the rows above which a key counts as heavy.
SUPPORT = 0.02
#: Buckets a heavy key's rows are spread over.
SALTS = 32
KEY, SALT = "_skew_key", "_skew_salt"


def _key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_keys(table: DataFrame, keys: Sequence[str], support: float = SUPPORT) -> list[int]:
    """64-bit hashes of the keys that may hold more than ``support`` of the rows.

    At most about ``1 / support`` hashes come back, whatever the table's size.
    """
    found = table.select(_key(keys).alias(KEY)).stat.freqItems([KEY], support).first()
    return sorted(found[0]) if found else []


def skew_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    support: float = SUPPORT,
    salts: int = SALTS,
) -> DataFrame:
    """``large.join(small, keys, how)`` with heavy keys of ``large`` spread out.

    ``how`` is one of inner, left, left_semi and left_anti: the joins in which
    each row of ``large`` finds its partners on its own. Null keys take the
    ordinary path. Columns named ``_skew_key`` or ``_skew_salt`` may not occur.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a join in which rows of the large side stand alone is needed, not {how}")
    heavy = heavy_keys(large, keys, support)
    if not heavy:
        return large.join(small, list(keys), how)
    marked = F.coalesce(_key(keys).isin(heavy), F.lit(False))
    light = large.where(~marked).join(small.where(~F.coalesce(_key(keys).isin(heavy), F.lit(False))), list(keys), how)
    spread = large.where(marked).withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.where(_key(keys).isin(heavy)).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = spread.join(copies, [*keys, SALT], how).drop(SALT)
    return light.unionByName(joined)
