"""Readers: telemetry facts from export files and from event tables."""
