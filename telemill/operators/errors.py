"""Raised errors: by type, by reason, by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import normalised, shortened
from ..functions.versions import version_struct
from ..plans.buckets import bucket_of
from ..plans.scope import Filters, facts

RAISED, DIMS = ("cli.error.raised",), ("cli_version", "os", "arch", "is_ci", "command_name")
# Consent tiers by rank.
TIERS = {"anonymous": 0, "basic": 1, "full": 2, "optin_plus": 3}
SAMPLE = 512


def error_types(logs: DataFrame, f: Filters, grain: str, *more: str) -> DataFrame:
    keys = ("command_name", "error_type", *more)
    out = facts(logs, f, *DIMS, events=RAISED).groupBy(*f.keys, bucket_of(grain, F.col("time")).alias("bucket"), *keys).agg(F.count("*").alias("errors"))
    return f.page(out, F.col("bucket").asc(), *(F.col(k).asc_nulls_last() for k in keys))


def error_reasons(logs: DataFrame, f: Filters, grain: str) -> DataFrame:
    return error_types(logs, f, grain, "error_reason")


def tier_rank(tier: Column) -> Column:
    """A consent tier's rank; null for an unknown one."""
    return F.coalesce(*[F.when(tier == t, r) for t, r in TIERS.items()])


def readable(logs: DataFrame, tenants: DataFrame) -> DataFrame:
    """Events whose tier is within their own tenant's present ceiling (tenant_id, tier_ceiling).

    A tenant without configuration, or an unknown tier on either side, reads nothing.
    """
    ceilings = tenants.select("tenant_id", tier_rank(F.col("tier_ceiling")).alias("__ceiling"))
    return logs.join(ceilings, "tenant_id").filter(tier_rank(F.col("consent_tier")) <= F.col("__ceiling")).drop("__ceiling")


def error_fingerprints(logs: DataFrame, tenants: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Errors by their stored fingerprint, most installs first: counts, first and last time, commands, versions, trend, and
    the latest event's source (stack or message), message without its variable parts, and top frame.

    The page is ranked first; trend and samples are made for that page only.
    """
    rows = readable(facts(logs, f, *DIMS, events=RAISED), tenants).withColumn("fp", F.col("error_fingerprint")).filter("fp is not null")
    by = [*f.keys, "fp"]
    ranked = rows.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_distinct("install_id").alias("installs"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("command_name")), ",").alias("commands"),
        F.array_join(F.transform(F.array_sort(F.collect_set(version_struct(F.col("cli_version")))), lambda v: v["version"]), ",").alias("versions"),
    )
    page = f.page(ranked, F.col("installs").desc(), F.col("events").desc(), F.col("fp").asc())
    top = page.select(*by)
    detail = rows.join(top if f.keys else F.broadcast(top), by, "left_semi")  # a page of at most 1000, of each tenant where it is every one
    trend = detail.groupBy(*by, bucket_of(grain, F.col("time")).alias("b")).agg(F.count("*").alias("n"), F.count_distinct("install_id").alias("i"))
    line = F.concat_ws(":", F.date_format("b", "yyyy-MM-dd HH"), F.col("n").cast("string"), F.col("i").cast("string"))
    trends = trend.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(line)), ";").alias("trend"))
    last = detail.groupBy(*by).agg(F.max_by(F.struct("error_source", "error_message", "top_frame"), F.struct("time", "id")).alias("s"))
    short = lambda c: F.nullif(shortened(c, SAMPLE), F.lit(""))
    samples = last.select(*by, F.col("s.error_source").alias("source"), short(normalised(F.col("s.error_message"))).alias("message"), short(F.col("s.top_frame")).alias("top_frame"))
    return page.join(trends, by).join(samples, by).orderBy(F.col("installs").desc(), F.col("events").desc(), "fp")
