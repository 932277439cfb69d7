"""Mergeable sketches: KLL quantiles, HyperLogLog counts, fixed-bucket histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_REGISTERS = 13  # log2

# Upper bounds of the histogram buckets; the last bucket is open.
MEASURE_BOUNDS = (1, 5, 10, 50, 100, 500, 1000, 5000, 10000, 60000, 300000)
VALUE_BOUNDS = (0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 5000, 10000, 100000)


def quantile_sketch(c: Column) -> Column:
    return F.call_function("kll_sketch_agg_double", c)


def merge_quantiles(c: Column) -> Column:
    return F.call_function("kll_merge_agg_double", c)


def read_quantile(sketch: Column, n: Column, q: float) -> Column:
    """A sketch's quantile; null where it holds nothing, as reading an empty sketch is an error."""
    return F.when(n > 0, F.call_function("kll_sketch_get_quantile_double", sketch, F.lit(float(q))))


def distinct_sketch(c: Column) -> Column:
    return F.hll_sketch_agg(c, F.lit(HLL_REGISTERS))


def merge_distinct(c: Column) -> Column:
    return F.hll_union_agg(c)


def read_distinct(sketch: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("long")


def installs_of(rows: DataFrame, sketch: str, where: Column | None = None) -> Column:
    """Distinct installs of rollup rows: their number where the rows are kept by install (those that meet `where`), else the merged sketches' estimate."""
    if "install_id" in rows.columns:
        return F.count_distinct(F.col("install_id") if where is None else F.when(where, F.col("install_id")))
    return read_distinct(merge_distinct(F.col(sketch)))


def one_hot(bucket: Column, n: int) -> list[Column]:
    """n columns b0.. of which the bucket's is 1."""
    return [F.when(bucket == i, 1).otherwise(0).cast("long").alias(f"b{i}") for i in range(n)]


def histogram_quantile(q: float, bounds: tuple[int, ...], least: Column, most: Column, prefix: str = "b") -> Column:
    """A quantile of bucket counts b0.. by linear interpolation.

    The first bucket reaches from the least value (or its bound if that is 0 or below, else 0), the last to
    the greatest value (else its lower bound); the result is held within least and most; null if empty.
    """
    n = len(bounds) + 1
    counts = F.array(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).cast("double") for i in range(n)])
    first = F.coalesce(least, F.lit(float(min(bounds[0], 0))))
    lows = F.array(first, *[F.lit(float(b)) for b in bounds])
    highs = F.array(*[F.lit(float(b)) for b in bounds], F.coalesce(F.greatest(most, F.lit(float(bounds[-1]))), F.lit(float(bounds[-1]))))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    rank = total * q
    buckets = F.zip_with(F.arrays_zip(counts.alias("c"), lows.alias("lo")), highs, lambda a, h: F.struct(a["c"].alias("c"), a["lo"].alias("lo"), h.alias("hi")))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("at"))

    def step(state: Column, b: Column) -> Column:
        here = state["at"].isNull() & (b["c"] > 0) & (state["seen"] + b["c"] >= rank)
        at = b["lo"] + (b["hi"] - b["lo"]) * (rank - state["seen"]) / b["c"]
        return F.struct((state["seen"] + b["c"]).alias("seen"), F.when(here, at).otherwise(state["at"]).alias("at"))

    found = F.aggregate(buckets, start, step, lambda s: s["at"])
    held = F.greatest(F.least(found, F.coalesce(most, found)), F.coalesce(least, found))
    return F.when(total > 0, held)
