"""Incremental mining and streaming deduplication."""
