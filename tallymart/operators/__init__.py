"""Reusable DataFrame operators built from joins, aggregates and windows."""
