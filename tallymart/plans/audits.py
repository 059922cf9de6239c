"""Plan limits checked over logs of requests and accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plan name to longest range in days, seller and category reports a day.
PLANS = {
    "demo": (30, 10, 10),
    "default": (30, 100, 0),
    "advanced": (90, 100, 100),
    "pro": (120, 100, 100),
}
UNLIMITED_HISTORY = "pro"  # Fixed value: the plan whose range may start any time ago.


def _limit(plan: Column, index: int) -> Column:
    value = F.lit(None).cast("int")
    for name, limits in PLANS.items():
        value = F.when(plan == name, F.lit(limits[index])).otherwise(value)
    return value


def _active(at: Column) -> Column:
    return F.col("subscription_type").isNotNull() & (F.col("subscription_end_at") >= at)


def report_quota_usage(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """Reports per user, day and kind against the daily limit of the plan."""
    daily = requests.groupBy(
        "user_id", F.to_date("created_at").alias("day"), "report_type"
    ).agg(F.count(F.lit(1)).alias("reports"), F.max("created_at").alias("_last"))
    plan = F.col("subscription_type")
    by_kind = F.when(F.col("report_type") == "seller", _limit(plan, 1)).otherwise(
        _limit(plan, 2)
    )
    limit = F.coalesce(F.when(_active(F.col("_last")), by_kind), F.lit(0))
    return (
        daily.join(plans, "user_id", "left")
        .withColumn("daily_limit", limit)
        .select(
            "user_id",
            "day",
            "report_type",
            "reports",
            "daily_limit",
            (F.col("reports") > F.col("daily_limit")).alias("over_quota"),
        )
    )


def request_entitlement_audit(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """PERMIT or PROHIBIT for every request for [from_date, to_date].

    An empty range is always permitted. Otherwise the plan must be active, allow
    the length, and, unless unlimited, reach back at most its length plus a day.
    """
    days = F.datediff("to_date", "from_date")
    plan = F.col("subscription_type")
    longest = _limit(plan, 0)
    oldest = F.date_sub(F.to_date("created_at"), longest + 1)
    allowed = (
        _active(F.col("created_at"))
        & days.between(F.lit(1), longest)
        & ((plan == UNLIMITED_HISTORY) | (F.col("from_date") >= oldest))
    )
    verdict = F.when(days <= 0, "PERMIT").when(allowed, "PERMIT").otherwise("PROHIBIT")
    return requests.join(plans, "user_id", "left").select(
        "job_id", "user_id", days.alias("days"), verdict.alias("verdict")
    )
