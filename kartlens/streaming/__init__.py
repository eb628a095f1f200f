"""Incremental CSV ingest with Structured Streaming."""
