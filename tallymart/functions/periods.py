"""The four reporting periods, always relative to an explicit day."""

from __future__ import annotations

import datetime as dt

# Period name to length in days.
PERIOD_DAYS = {"week": 7, "two_week": 14, "month": 30, "two_month": 60}

# What an unspecified period means for a date range and for a
# snapshot table; the two differ.
UNSPECIFIED_RANGE = "week"
UNSPECIFIED_TABLE = "month"


def period_range(as_of: dt.date, period: str | None = None) -> tuple[dt.date, dt.date]:
    """First and last day of a period that ends on ``as_of``."""
    days = PERIOD_DAYS[period or UNSPECIFIED_RANGE]
    return as_of - dt.timedelta(days=days), as_of


def snapshot_period(period: str | None = None) -> int:
    """Length in days of the snapshot that serves ``period``."""
    return PERIOD_DAYS[period or UNSPECIFIED_TABLE]
