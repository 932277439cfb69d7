"""Questions about commands: spans, latency, errors, exit codes, resources, unknown commands, friction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sketches import merge_quantiles, read_quantile
from ..plans.buckets import bucket_of, rebucket, stored_grain
from ..plans.scope import Filters, all_of, facts, rollup

DIMS = ("cli_version", "os", "arch", "is_ci", "command_name")


def rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def list_traces(traces: DataFrame, f: Filters) -> DataFrame:
    """Raw spans by all filters, newest first, paged."""
    f.check_patterns(traces.sparkSession)
    rows = facts(traces, f, *DIMS, "exit_code").filter(all_of(f.attributes()))
    return f.page(rows, F.col("time").desc(), F.col("id").asc())


def _bucketed(stats: DataFrame, f: Filters, grain: str, *keys: str) -> DataFrame:
    rows = rollup(stats, f, *DIMS).withColumn("bucket", rebucket(grain, F.col("bucket"), stored_grain(grain)))
    return rows.groupBy(*f.keys, "bucket", *keys)


def latency_percentiles(stats: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per bucket and command the runs and p50, p95, p99 of their durations, from merged sketches."""
    merged = _bucketed(stats, f, grain, "command_name").agg(F.sum("invocations").alias("invocations"), merge_quantiles(F.col("durations")).alias("s"))
    at = lambda q: read_quantile(F.col("s"), F.col("invocations"), q)
    out = merged.select(*f.keys, "bucket", "command_name", "invocations", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last())


def exact_latency_percentiles(traces: DataFrame, f: Filters, grain: str) -> DataFrame:
    """The same from raw spans, exact and interpolated."""
    rows = facts(traces, f, *DIMS).withColumn("bucket", bucket_of(grain, F.col("time")))
    at = lambda q: F.expr(f"percentile_cont({q}) within group (order by duration_ms)")
    out = rows.groupBy(*f.keys, "bucket", "command_name").agg(F.count("*").alias("invocations"), *(at(q).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))))
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last())


def error_rate(stats: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per bucket and command the runs, the failed ones (no exit code is a failure) and their share."""
    out = _bucketed(stats, f, grain, "command_name").agg(F.sum("invocations").alias("invocations"), F.sum("errors").alias("errors"))
    out = out.withColumn("error_rate", rate(F.col("errors"), F.col("invocations")))
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last())


def command_frequency(stats: DataFrame, f: Filters, grain: str) -> DataFrame:
    out = _bucketed(stats, f, grain, "command_name").agg(F.sum("invocations").alias("invocations"))
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last())


def ci_split(stats: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per bucket the runs in CI, out of it and unknown."""
    out = _bucketed(stats, f, grain, "is_ci").agg(F.sum("invocations").alias("invocations"))
    return f.page(out, F.col("bucket").asc(), F.col("is_ci").asc_nulls_last())


def exit_codes(codes: DataFrame, f: Filters, grain: str) -> DataFrame:
    rows = rollup(codes, f, *DIMS, "exit_code").withColumn("bucket", F.date_trunc(grain, "bucket"))
    out = rows.groupBy(*f.keys, "bucket", "command_name", "exit_code").agg(F.sum("invocations").alias("invocations"))
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last(), F.col("exit_code").asc_nulls_last())


def resource_usage(resources: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per bucket, command and version how many reported memory and CPU time, and percentiles; null without reports."""
    merged = _bucketed(resources, f, grain, "command_name", "cli_version").agg(
        F.sum("rss_reported").alias("rss_reported"), F.sum("cpu_reported").alias("cpu_reported"), merge_quantiles(F.col("rss")).alias("rss"), merge_quantiles(F.col("cpu")).alias("cpu")
    )
    reads = [read_quantile(F.col(s), F.col(f"{s}_reported"), q).alias(f"{s}_p{int(q * 100)}") for s in ("rss", "cpu") for q in (0.5, 0.95, 0.99)]
    out = merged.select(*f.keys, "bucket", "command_name", "cli_version", "rss_reported", "cpu_reported", *reads)
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last(), F.col("cli_version").asc_nulls_last())


def list_dimensions(stats: DataFrame, f: Filters, most: int = 1000) -> DataFrame:
    """Known values of each dimension, sorted, at most so many of each."""
    from pyspark.sql import Window as W

    names = ("cli_version", "os", "arch", "command_name")
    # one scan: each row's values beside their names
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names])).alias("d")
    rows = stats.filter(f.tenant()).select(*f.keys, pairs).select(*f.keys, "d.*").filter("value is not null").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*f.keys, "dimension").orderBy("value")))
    return ranked.filter(F.col("rank") <= most).drop("rank").orderBy("dimension", "value")


def unknown_commands(logs: DataFrame, stats: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per bucket attempts at unknown commands against invocations; a command filter does not apply."""
    dims = ("cli_version", "os", "arch", "is_ci")
    tried = facts(logs, f, *dims, events=("cli.command.unknown",)).groupBy(*f.keys, bucket_of(grain, F.col("time")).alias("bucket")).agg(F.count("*").alias("attempts"))
    ran = rollup(stats, f, *dims).groupBy(*f.keys, F.date_trunc(grain, "bucket").alias("bucket")).agg(F.sum("invocations").alias("invocations"))
    out = tried.join(ran, [*f.keys, "bucket"], "full_outer").select(*f.keys, "bucket", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("invocations", F.lit(0)).alias("invocations"))
    return out.withColumn("attempt_rate", rate(F.col("attempts"), F.col("invocations"))).orderBy("bucket")


def unknown_suggestions(logs: DataFrame, stats: DataFrame, f: Filters) -> DataFrame:
    """Suggestions that are commands of the tenant, the commonest by name; the rest folded into kind other.

    An empty suggestion is none.  other counts the suggestions left out and the attempts behind them.
    """
    rows = facts(logs, f, "cli_version", "os", "arch", "is_ci", events=("cli.command.unknown",)).select(*f.keys, F.nullif("suggestion", F.lit("")).alias("suggestion"))
    counts = rows.filter("suggestion is not null").groupBy(*f.keys, "suggestion").agg(F.count("*").alias("attempts"))
    known = stats.filter(f.tenant()).select(*f.keys, F.col("command_name").alias("suggestion")).filter("suggestion is not null").distinct()
    listed = f.page(counts.join(known, [*f.keys, "suggestion"], "left_semi"), F.col("attempts").desc(), F.col("suggestion").asc(), offset=0)
    whole = f.whole(counts, F.count("*").alias("n"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    part = f.whole(listed, F.count("*").alias("n_l"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("a_l"))
    left = lambda c, p: (F.col(c) - F.coalesce(F.col(p), F.lit(0)))
    other = f.beside(whole, part).select(*f.keys, F.lit("other").alias("kind"), F.lit(None).cast("string").alias("suggestion"), left("attempts", "a_l").alias("attempts"), left("n", "n_l").alias("suggestions"))
    return listed.select(*f.keys, F.lit("value").alias("kind"), "suggestion", "attempts", F.lit(1).cast("long").alias("suggestions")).unionByName(other)


def friction(codes: DataFrame, logs: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per bucket and command runs, interrupted runs (exit code 130) and help views."""
    ran = rollup(codes, f, *DIMS).groupBy(*f.keys, F.date_trunc(grain, "bucket").alias("bucket"), "command_name").agg(
        F.sum("invocations").alias("invocations"), F.coalesce(F.sum(F.when(F.col("exit_code") == 130, F.col("invocations"))), F.lit(0)).alias("interrupted")
    )
    helped = facts(logs, f, *DIMS, events=("cli.help.viewed",)).groupBy(*(F.col(k).alias(f"h_{k}") for k in f.keys), bucket_of(grain, F.col("time")).alias("h_bucket"), F.col("command_name").alias("h_command")).agg(F.count("*").alias("help_views"))
    same = all_of([F.col(a).eqNullSafe(F.col(b)) for a, b in (("bucket", "h_bucket"), ("command_name", "h_command"), *((k, f"h_{k}") for k in f.keys))])
    joined = ran.join(helped, same, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = joined.select(
        *(F.coalesce(k, f"h_{k}").alias(k) for k in f.keys), F.coalesce("bucket", "h_bucket").alias("bucket"), F.when(F.col("bucket").isNull(), F.col("h_command")).otherwise(F.col("command_name")).alias("command_name"),
        zero("invocations"), zero("interrupted"), zero("help_views"),
    )
    return f.page(out, F.col("bucket").asc(), F.col("command_name").asc_nulls_last())
