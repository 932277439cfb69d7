"""Incremental rollups: tumbling-window aggregates whose states merge, hour to day, with a live tail.

A rollup is declared once: the rows it takes, its dimensions, its states and how each state merges.  From
that come the batch build from facts, the build of days from hours, the refresh of a range of dates by
partition overwrite, and the read that adds what has arrived since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sketches import MEASURE_BOUNDS, VALUE_BOUNDS, distinct_sketch, merge_distinct, merge_quantiles, quantile_sketch

_DIMS = ("tenant_id", "cli_version", "os", "arch", "is_ci")
_VENDOR = (*_DIMS, "service_name", "command_name", "name", "label")
_PLUS: Callable[[str], Column] = lambda c: F.sum(c)


@dataclass(frozen=True)
class Rollup:
    """states: name -> (aggregate over facts, merge of the stored state)."""

    name: str
    fact: str
    takes: str
    dims: tuple[str, ...]
    grain: str
    states: dict[str, tuple[Column, Callable[[str], Column]]]

    def build(self, facts: DataFrame) -> DataFrame:
        """The rollup of these facts: bucket, dimensions and states; null dimensions are groups."""
        taken = facts.filter(self.takes).withColumn("bucket", F.date_trunc(self.grain, "time"))
        return taken.groupBy("bucket", *self.dims).agg(*(made.alias(k) for k, (made, _) in self.states.items()))

    def merge(self, rolled: DataFrame, grain: str | None = None) -> DataFrame:
        """States of equal buckets merged; with a grain, buckets made coarser first."""
        rolled = rolled.withColumn("bucket", F.date_trunc(grain, "bucket")) if grain else rolled
        return rolled.groupBy("bucket", *self.dims).agg(*(merge(k).alias(k) for k, (_, merge) in self.states.items()))

    def stream(self, facts: DataFrame, late: str = "1 day") -> DataFrame:
        """The rollup's days of a stream of facts: its hours by one window, merged to days by a second one; a day's rollup by one.

        A day is emitted (append mode) once the watermark has passed it.
        """
        taken = facts.filter(self.takes).withWatermark("time", late)
        out = taken.groupBy(F.window("time", f"1 {self.grain}"), *self.dims).agg(*(made.alias(k) for k, (made, _) in self.states.items()))
        if self.grain != "day":
            out = out.groupBy(F.window(F.window_time("window"), "1 day"), *self.dims).agg(*(merge(k).alias(k) for k, (_, merge) in self.states.items()))
        return out.select(F.col("window.start").alias("bucket"), *self.dims, *self.states)

    def live(self, stored: DataFrame, facts: DataFrame, watermark: datetime) -> DataFrame:
        """Stored buckets before the watermark, and later facts rolled up now.

        The watermark is cut to a bucket's start, so that no bucket comes from both.
        """
        edge = F.date_trunc(self.grain, F.lit(watermark))
        return stored.filter(F.col("bucket") < edge).unionByName(self.build(facts.filter(F.col("time") >= edge)))

    def refresh(self, facts: DataFrame, path: str, first: date, last: date) -> None:
        """Builds the dates from first to before last anew, and overwrites just their partitions; dates without rows go."""
        inside = facts.filter((F.col("time") >= F.lit(first).cast("timestamp")) & (F.col("time") < F.lit(last).cast("timestamp")))
        made = self.build(inside).withColumn("date", F.to_date("bucket"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        # a date whose rows have all gone has no partition to overwrite it with
        spark = facts.sparkSession
        have = {r.date for r in spark.read.parquet(path).select("date").filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(last))).distinct().collect()} if first < last else set()
        full = {r.date for r in inside.filter(self.takes).select(F.to_date("time").alias("date")).distinct().collect()}
        for day in have - full:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/date={day.isoformat()}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _sum(c: Column) -> tuple[Column, Callable[[str], Column]]:
    return F.coalesce(F.sum(c), F.lit(0)), _PLUS


def _count(condition: Column | None = None) -> tuple[Column, Callable[[str], Column]]:
    return (F.count("*") if condition is None else F.count_if(condition)), _PLUS


def _quantiles(c: str) -> tuple[Column, Callable[[str], Column]]:
    return quantile_sketch(F.col(c).cast("double")), lambda k: merge_quantiles(F.col(k))


def _distinct(c: Column) -> tuple[Column, Callable[[str], Column]]:
    return distinct_sketch(c), lambda k: merge_distinct(F.col(k))


_COMMAND = "span_name like 'cli.command.%' or span_name like 'cli.subcommand.%'"


def _install() -> dict:
    return {"reach": _distinct(F.col("install_id")), "reported": _count(F.col("install_id").isNotNull())}


def _histogram(bounds: tuple[int, ...]) -> dict:
    return {
        "points": _count(), "n": _sum(F.col("n")), "total": _sum(F.col("total")), "least": (F.min("least"), lambda k: F.min(k)), "most": (F.max("most"), lambda k: F.max(k)),
        **{f"b{i}": _sum(F.col(f"b{i}")) for i in range(len(bounds) + 1)}, **_install(),
    }


def rollups() -> dict[str, Rollup]:
    """Every rollup by name; a day's rollup is `merge(hourly, 'day')` of the hourly one of its name."""
    has = lambda c: F.col(c).isNotNull()
    both = [
        Rollup("command_stats", "traces", _COMMAND, (*_DIMS, "command_name"), "hour",
               {"invocations": _count(), "errors": _count(~F.col("exit_code").eqNullSafe(0)), "durations": _quantiles("duration_ms")}),
        Rollup("exit_codes", "traces", _COMMAND, (*_DIMS, "command_name", "exit_code"), "hour", {"invocations": _count()}),
        Rollup("command_resources", "traces", _COMMAND, (*_DIMS, "command_name"), "hour",
               {"invocations": _count(), "rss_reported": _count(has("peak_rss_bytes")), "cpu_reported": _count(has("cpu_time_ms")),
                "rss": _quantiles("peak_rss_bytes"), "cpu": _quantiles("cpu_time_ms")}),
        Rollup("session_activity", "logs", "event_name = 'cli.session.started'", _DIMS, "day", {"sessions": _count(), "installs": _distinct(F.col("install_id"))}),
        Rollup("session_footprint", "logs", "event_name = 'cli.session.started'", _DIMS, "day",
               {"sessions": _count(), "size_reported": _count(has("binary_size_bytes")), "least_size": (F.min("binary_size_bytes"), lambda k: F.min(k)),
                "most_size": (F.max("binary_size_bytes"), lambda k: F.max(k)), "sizes": _quantiles("binary_size_bytes"),
                "startup_reported": _count(has("startup_ms")), "startups": _quantiles("startup_ms"),
                "size_installs": _distinct(F.when(has("binary_size_bytes"), F.col("install_id"))), "startup_installs": _distinct(F.when(has("startup_ms"), F.col("install_id")))}),
        # kept by install as well: these count installs exactly, where a sketch estimates
        Rollup("session_installs", "logs", "event_name = 'cli.session.started'", (*_DIMS, "install_id"), "day",
               {"sessions": _count(), "size_reported": _count(has("binary_size_bytes")), "startup_reported": _count(has("startup_ms"))}),
        Rollup("counter_installs", "metrics", "metric_name = 'cli.counter'", (*_VENDOR, "install_id"), "hour",
               {"total": _sum(F.col("obs")), "points": _count(), "reported": _count(F.col("install_id").isNotNull())}),
        Rollup("counters", "metrics", "metric_name = 'cli.counter'", _VENDOR, "hour", {"total": _sum(F.col("obs")), "points": _count(), **_install()}),
        Rollup("measures", "metrics", "metric_name = 'cli.measure'", _VENDOR, "hour", _histogram(MEASURE_BOUNDS)),
        Rollup("values", "metrics", "metric_name = 'cli.value'", _VENDOR, "hour", _histogram(VALUE_BOUNDS) | {"unit": (F.max(F.coalesce("unit", F.lit("1"))), lambda k: F.max(k))}),
    ]
    return {r.name: r for r in both}
