"""Ratios, percentage change, truncation and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ISO 4217 numeric code written into every money struct.
CURRENCY_CODE = "860"

EXACT = "decimal(38,18)"


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double; NULL where ``bottom`` is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio_if(condition: Column, top: Column, bottom: Column) -> Column:
    """``top / bottom`` where ``condition`` holds, else 0."""
    return F.when(condition, ratio(top, bottom)).otherwise(F.lit(0.0))


def trunc_decimal(value: Column, digits: int) -> Column:
    """Cut a decimal to ``digits`` places toward zero."""
    size = F.floor(F.abs(value.cast(EXACT)), F.lit(digits)).cast(f"decimal(30,{digits})")
    return F.when(value < 0, -size).otherwise(size)


def pct_diff(previous: Column, current: Column) -> Column:
    """Percentage change of two amounts, cut to one digit; 0 if ``previous`` is 0.

    The share is rounded half up to ten places before it becomes a percentage.
    """
    previous, current = previous.cast("double"), current.cast("double")
    share = F.round(F.try_divide(current - previous, F.abs(previous)), 10)
    percent = share.cast("decimal(28,10)") * F.lit(100).cast("decimal(3,0)")
    return F.when(previous == 0, F.lit(0).cast("decimal(30,1)")).otherwise(
        trunc_decimal(percent, 1)
    )


def pct_diff_count(previous: Column, current: Column) -> Column:
    """Percentage change of two counts, computed in doubles and then cut."""
    change = (current - previous).cast("double")
    percent = F.try_divide(change, previous.cast("double")) * F.lit(100.0)
    return F.when(previous == 0, F.lit(0).cast("decimal(30,1)")).otherwise(
        trunc_decimal(percent, 1)
    )


def to_money(amount: Column) -> Column:
    """Struct of currency code, whole units and nanos, both cut toward zero."""
    exact = amount.cast(EXACT)
    units = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast("bigint")
    part = (exact - units.cast("decimal(19,0)")).cast("decimal(19,18)")
    nanos = part * F.lit(10**9).cast("decimal(10,0)")
    return F.struct(
        F.lit(CURRENCY_CODE).alias("currency_code"),
        units.alias("units"),
        nanos.cast("int").alias("nanos"),
    )


def price_to_minor(text: Column) -> Column:
    """``"12.50"`` to 1250; an empty or unreadable string to NULL."""
    amount = F.nullif(text, F.lit("")).try_cast("decimal(20,4)")
    return (amount * F.lit(100).cast("decimal(3,0)")).cast("bigint")


def unreadable_price(text: Column) -> Column:
    """Whether a text is there but is no price."""
    return F.coalesce((text != "") & text.try_cast("decimal(20,4)").isNull(), F.lit(False))
