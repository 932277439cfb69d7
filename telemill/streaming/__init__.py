"""Structured Streaming jobs: ingest and rollups."""
