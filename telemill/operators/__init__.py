"""Operators over telemetry facts, rollups and derived state."""
