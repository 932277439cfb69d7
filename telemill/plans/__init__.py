"""Scope, filters, time buckets and the choice of a rollup."""
