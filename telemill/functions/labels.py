"""Dimension labels: sorted tuples k1=v1;k2=v2 and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of(dims: Column) -> Column:
    """A map's label, keys in order; null for no dimensions; a single `label` is written plainly."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    alone = (F.size(dims) == 1) & F.map_contains_key(dims, "label")
    return F.when(F.coalesce(F.size(dims), F.lit(0)) <= 0, None).when(alone, dims["label"]).otherwise(pairs)


def dims_of(label: Column) -> Column:
    """A label's map; a plain one is {label: it}."""
    return F.when(label.isNull() | (label == ""), None).when(F.contains(label, F.lit("=")), F.str_to_map(label, F.lit(";"), F.lit("="))).otherwise(F.create_map(F.lit("label"), label))
