"""Structured Streaming ingest and running state."""
