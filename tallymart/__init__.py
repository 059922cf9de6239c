"""Marketplace analytics on PySpark: roll-ups, period snapshots and reports."""

from tallymart.marketplace import Marketplace
from tallymart.session import build_session, shared_folder

__all__ = ["Marketplace", "build_session", "shared_folder"]
