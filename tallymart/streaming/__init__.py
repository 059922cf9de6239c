"""Structured Streaming: decoding, routing and incremental tables."""
