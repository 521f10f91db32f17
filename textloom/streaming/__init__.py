"""Structured Streaming jobs: ingest, incremental rollups, deduplication, attempts."""
