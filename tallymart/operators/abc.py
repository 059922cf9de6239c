"""ABC classes by cumulative share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.operators.spread import running_above

# Below the first share a row is A, below the second B.
A_BELOW = "0.81"
B_BELOW = "0.96"

EXACT = "decimal(20,2)"


def abc_cutoffs(rows: DataFrame, report: list[str], values: list[str]) -> DataFrame:
    """Per report and value column: the total and the smallest A and B values.

    The share of a value is everything greater plus itself once, over the
    total. It never falls as the value falls, so two cut-offs say it all. All
    columns are ranked in one pass, in exact decimals.
    """
    pairs = F.array(
        *(F.struct(F.lit(v).alias("_metric"), F.col(v).cast(EXACT).alias("_value")) for v in values)
    )
    melted = rows.select(*report, F.inline(pairs))
    shares = running_above(melted, [*report, "_metric"], "_value")
    reached = F.col("above") + F.col("_value")

    def smallest(value: str, limit: str):
        bound = F.col("total") * F.lit(limit).cast("decimal(3,2)")
        within = (F.col("_metric") == value) & (reached < bound)
        return F.min(F.when(within, F.col("_value")))

    return shares.groupBy(*report).agg(
        *(F.max(F.when(F.col("_metric") == v, F.col("total"))).alias(f"_{v}_total") for v in values),
        *(smallest(v, A_BELOW).alias(f"_{v}_a") for v in values),
        *(smallest(v, B_BELOW).alias(f"_{v}_b") for v in values),
    )


def abc_classify(rows: DataFrame, report: list[str], classes: Mapping[str, str]) -> DataFrame:
    """Add ABC classes within ``report``; ``classes`` maps values to new columns.

    The class is NULL where all values of a report are zero. The cut-offs have
    one row per report, so the join carries no ranking.
    """
    cuts = abc_cutoffs(rows, report, list(classes))

    def grade(value: str):
        return (
            F.when(F.col(f"_{value}_total") == 0, F.lit(None))
            .when(F.col(value) >= F.col(f"_{value}_a"), "A")
            .when(F.col(value) >= F.col(f"_{value}_b"), "B")
            .otherwise("C")
        )

    return rows.join(cuts, report).select(
        *rows.columns, *(grade(value).alias(out) for value, out in classes.items())
    )
