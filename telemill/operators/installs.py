"""Installs: their state from events, version changes and first uses, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import compare
from ..plans.buckets import bucket_of, periods_between
from ..plans.scope import Filters, all_of, facts, rollup
from ..functions.sketches import installs_of

DONE = "cli.command.completed"


def install_states(logs: DataFrame) -> DataFrame:
    """One row for each (tenant, install): what its events, in time order, say of it.

    first_version is the earliest event's, null or not; last_* are the latest known values; the method is the
    last one reported.  All by partial aggregates: no event list of an install is ever gathered.
    """
    at = F.struct("time", "id")
    latest = lambda c, known: F.max_by(c, F.when(known, at))
    done = F.col("event_name") == DONE
    named = F.col("install_method").isNotNull() & (F.col("install_method") != "")
    return (
        logs.filter("install_id is not null").groupBy("tenant_id", "install_id")
        .agg(
            F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.min_by("cli_version", at).alias("first_version"),
            *(latest(c, F.col(c).isNotNull()).alias(n) for c, n in (("cli_version", "last_version"), ("os", "last_os"), ("arch", "last_arch"))),
            latest("install_method", named).alias("install_method"),
            F.min(F.when(done, F.col("time"))).alias("first_command_at"), F.min(F.when(done & (F.col("exit_code") == 0), F.col("time"))).alias("first_success_at"),
        )
    )


#: What an install's state holds so that states merge: values stand with the place (time, id) that they come from.
MARKS = (
    "tenant_id string, install_id string, first_seen timestamp, last_seen timestamp, first struct<time:timestamp,id:bigint,value:string>, "
    + ", ".join(f"{c} struct<time:timestamp,id:bigint,value:string>" for c in ("version", "os", "arch", "method"))
    + ", first_command_at timestamp, first_success_at timestamp"
)


def install_marks(logs: DataFrame) -> DataFrame:
    """install_states with the place of each value: marks of parts of the events merge to those of all, in any order."""
    known = lambda c: F.struct("time", F.col("id").cast("bigint").alias("id"), F.col(c).alias("value"))
    done = F.col("event_name") == DONE
    latest = (("cli_version", "version"), ("os", "os"), ("arch", "arch"), ("install_method", "method"))
    return logs.filter("install_id is not null").groupBy("tenant_id", "install_id").agg(
        F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.min(known("cli_version")).alias("first"),
        *(F.max(F.when(F.col(c).isNotNull() & ((F.col(c) != "") | F.lit(c != "install_method")), known(c))).alias(n) for c, n in latest),
        F.min(F.when(done, F.col("time"))).alias("first_command_at"), F.min(F.when(done & (F.col("exit_code") == 0), F.col("time"))).alias("first_success_at"),
    )


def merge_marks(*parts: DataFrame) -> DataFrame:
    """Marks of several parts of the events as those of all."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    least, most = ("first_seen", "first", "first_command_at", "first_success_at"), ("last_seen", "version", "os", "arch", "method")
    return every.groupBy("tenant_id", "install_id").agg(*(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most))


def states_of(marks: DataFrame) -> DataFrame:
    """install_states from marks."""
    return marks.select(
        "tenant_id", "install_id", "first_seen", "last_seen", F.col("first.value").alias("first_version"), F.col("version.value").alias("last_version"),
        F.col("os.value").alias("last_os"), F.col("arch.value").alias("last_arch"), F.col("method.value").alias("install_method"), "first_command_at", "first_success_at",
    )


def version_changes(logs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Where an install's known version differs from the last one known before, strictly later in time.

    before: marks of earlier events, of which one row an install stands before its events here.  An event older than
    what is marked neither changes a version nor is one to change from.
    """
    w = W.partitionBy("tenant_id", "install_id").orderBy("__new", "time", "id")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    rows = logs.filter("install_id is not null").select("tenant_id", "install_id", "time", F.col("id").cast("bigint").alias("id"), "cli_version", F.lit(True).alias("__new"))
    if before is not None:
        asked = before.join(rows.select("tenant_id", "install_id").distinct(), ["tenant_id", "install_id"], "left_semi")
        old = asked.select("tenant_id", "install_id", F.col("last_seen").alias("time"), F.lit(None).cast("bigint").alias("id"), F.col("version.value").alias("cli_version"), F.lit(False).alias("__new"))
        rows = rows.unionByName(old)
    rows = rows.withColumn("seen", F.max("time").over(earlier))
    rows = rows.withColumn("cli_version", F.when(F.col("seen").isNull() | (F.col("time") >= F.col("seen")), F.col("cli_version")))
    rows = rows.withColumn("from_version", F.last("cli_version", ignorenulls=True).over(earlier))
    moved = rows.filter("__new and cli_version is not null and from_version <> cli_version and time > seen").withColumn("c", compare(F.col("from_version"), F.col("cli_version")))
    return moved.filter("c <> 0").select(
        "tenant_id", "install_id", F.col("time").alias("changed_at"), "from_version", F.col("cli_version").alias("to_version"), F.when(F.col("c") < 0, "upgrade").otherwise("downgrade").alias("direction")
    )


def discoveries(logs: DataFrame, flags: str | None = None) -> DataFrame:
    """First use of each feature (and flag, from an array column) by each install."""
    known = logs.filter("install_id is not null")
    used = known.filter("event_name = 'cli.feature.activated' and feature <> ''").select("tenant_id", "install_id", F.lit("feature").alias("kind"), F.col("feature").alias("name"), "time")
    if flags:
        given = known.filter("event_name = 'cli.command.invoked'").select("tenant_id", "install_id", F.lit("flag").alias("kind"), F.explode(F.array_distinct(F.col(flags))).alias("name"), "time")
        used = used.unionByName(given)
    return used.groupBy("tenant_id", "install_id", "kind", "name").agg(F.min("time").alias("first_at"))


def cohort(installs: DataFrame, f: Filters) -> DataFrame:
    """Installs first seen in the range; filters are on what they were first and last seen with."""
    conditions = [f.tenant(), f.time("first_seen")]
    for c, values in (("first_version", f.versions), ("last_os", f.systems), ("last_arch", f.archs)):
        if values:
            conditions.append(F.col(c).isin(list(values)))
    return installs.filter(all_of(conditions))


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def install_funnel(installs: DataFrame, f: Filters, grain: str) -> DataFrame:
    rows = cohort(installs, f).groupBy(*f.keys, bucket_of(grain, F.col("first_seen")).alias("bucket"))
    return rows.agg(F.count("*").alias("installs"), F.count("first_command_at").alias("ran_command"), F.count("first_success_at").alias("succeeded")).orderBy("bucket")


def install_activation(installs: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Per cohort its size, how many reached a first success, and p50 and p90 of the seconds it took."""
    rows = cohort(installs, f).withColumn("secs", seconds(F.col("first_success_at"), F.col("first_seen")))
    at = lambda q: F.expr(f"percentile_cont({q}) within group (order by secs)")
    out = rows.groupBy(*f.keys, bucket_of(grain, F.col("first_seen")).alias("bucket")).agg(
        F.count("*").alias("cohort_size"), F.count("first_success_at").alias("activated"), at(0.5).alias("p50_seconds"), at(0.9).alias("p90_seconds")
    )
    return out.orderBy("bucket")


def version_change_series(changes: DataFrame, installs: DataFrame, f: Filters, grain: str) -> DataFrame:
    rows = changes.filter(all_of([f.tenant(), f.time("changed_at"), *([F.col("to_version").isin(list(f.versions))] if f.versions else [])]))
    if f.systems or f.archs:
        rows = rows.join(installs.select("tenant_id", "install_id", "last_os", "last_arch"), ["tenant_id", "install_id"], "left")
        rows = rows.filter(all_of([F.col(c).isin(list(v)) for c, v in (("last_os", f.systems), ("last_arch", f.archs)) if v]))
    out = rows.groupBy(*f.keys, bucket_of(grain, F.col("changed_at")).alias("bucket"), "from_version", "to_version", "direction").agg(
        F.count("*").alias("changes"), F.count_distinct("install_id").alias("installs")
    )
    return f.page(out, F.col("bucket").asc(), F.col("from_version").asc(), F.col("to_version").asc(), F.col("direction").asc())


def install_coverage(logs: DataFrame, f: Filters, grain: str) -> DataFrame:
    rows = facts(logs, f, "cli_version", "os", "arch", "is_ci", events=("cli.session.started",))
    return rows.groupBy(*f.keys, bucket_of(grain, F.col("time")).alias("bucket")).agg(F.count("*").alias("sessions"), F.count("install_id").alias("with_install")).orderBy("bucket")


def install_methods(installs: DataFrame, f: Filters, grain: str) -> DataFrame:
    out = cohort(installs, f).groupBy(*f.keys, bucket_of(grain, F.col("first_seen")).alias("bucket"), "install_method").agg(F.count("*").alias("installs"))
    return f.page(out, F.col("bucket").asc(), F.col("install_method").asc_nulls_last())


def new_vs_returning(logs: DataFrame, installs: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Active installs per bucket: new in the bucket of their first event, returning later."""
    rows = facts(logs, f, "cli_version", "os", "arch", "is_ci", events=("cli.session.started",), install=True)
    active = rows.select("tenant_id", "install_id", bucket_of(grain, F.col("time")).alias("bucket")).distinct()
    joined = active.join(installs.select("tenant_id", "install_id", bucket_of(grain, F.col("first_seen")).alias("born")), ["tenant_id", "install_id"])
    return joined.groupBy(*f.keys, "bucket").agg(F.count_if(F.col("born") == F.col("bucket")).alias("new"), F.count_if(F.col("born") < F.col("bucket")).alias("returning")).orderBy("bucket")


def feature_discovery(installs: DataFrame, found: DataFrame, f: Filters) -> DataFrame:
    """Per feature or flag the cohort's installs that used it, within 1, 7 and 30 days, and the median seconds."""
    members = cohort(installs, f).select("tenant_id", "install_id", "first_seen")
    rows = found.join(members, ["tenant_id", "install_id"]).withColumn("secs", F.greatest(seconds(F.col("first_at"), F.col("first_seen")), F.lit(0.0)))
    out = rows.groupBy(*f.keys, "kind", "name").agg(
        F.count("*").alias("installs"), *(F.count_if(F.col("secs") <= d * 86400).alias(f"within_{d}d") for d in (1, 7, 30)),
        F.expr("percentile_cont(0.5) within group (order by secs)").alias("median_seconds"),
    )
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy(*f.keys, "kind").orderBy(F.col("installs").desc(), "name")))
    size = f.whole(members, F.count("*").alias("cohort_size"))
    page = ranked.filter((F.col("rank") > f.offset) & (F.col("rank") <= f.offset + f.rows))
    return f.beside(page, size).orderBy("kind", "rank").drop("rank")


def session_cohort(activity: DataFrame, f: Filters, grain: str) -> DataFrame:
    rows = rollup(activity, f, "cli_version", "os", "arch", "is_ci").groupBy(*f.keys, F.date_trunc(grain, "bucket").alias("bucket"), "cli_version", "os", "arch")
    return f.page(rows.agg(F.sum("sessions").alias("sessions")), F.col("bucket").asc(), *(F.col(c).asc_nulls_last() for c in ("cli_version", "os", "arch")))


def active_installs(activity: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Distinct installs per bucket, from rows by install or merged sketches: never a sum of counts."""
    rows = rollup(activity, f, "cli_version", "os", "arch", "is_ci")
    return rows.groupBy(*f.keys, F.date_trunc(grain, "bucket").alias("bucket")).agg(installs_of(rows, "installs").alias("installs")).orderBy("bucket")


def retention(logs: DataFrame, f: Filters, grain: str) -> DataFrame:
    """Installs active in each period after the one they first appeared in, over all history before the end."""
    conditions = [f.tenant(), F.col("time") < F.lit(f.end), F.col("event_name") == "cli.session.started", F.col("install_id").isNotNull(), *f.any_of("cli_version", "os", "arch", "is_ci")]
    active = logs.filter(all_of(conditions)).select(*f.keys, "install_id", bucket_of(grain, F.col("time")).alias("period")).distinct()
    born = active.groupBy(*f.keys, "install_id").agg(F.min("period").alias("cohort"))
    kept = born.filter(F.col("cohort") >= F.date_trunc(grain, F.lit(f.start)))
    counts = active.join(kept, [*f.keys, "install_id"]).groupBy(*f.keys, "cohort", periods_between(grain, F.col("cohort"), F.col("period")).alias("period")).agg(F.count("*").alias("installs"))
    size = F.first("installs").over(W.partitionBy(*f.keys, "cohort").orderBy("period"))
    return counts.withColumn("cohort_size", size).orderBy("cohort", "period")


def version_footprint(footprint: DataFrame, f: Filters, activity: DataFrame | None = None) -> DataFrame:
    """Per version its sessions, binary sizes and startup times, in the order of versions; activity: the sessions by install, to count installs exactly."""
    from ..functions.sketches import merge_quantiles, read_quantile
    from ..functions.versions import version_order

    scoped = lambda df: rollup(df, f, "cli_version", "os", "arch", "is_ci")
    reported = lambda rows: [installs_of(rows, f"{k}_installs", F.col(f"{k}_reported") > 0).alias(f"{k}_installs") for k in ("size", "startup")]
    rows = scoped(footprint)
    made = rows.groupBy(*f.keys, "cli_version").agg(
        *(F.sum(c).alias(c) for c in ("sessions", "size_reported", "startup_reported")), F.min("least_size").alias("least_size"), F.max("most_size").alias("most_size"),
        merge_quantiles(F.col("sizes")).alias("s"), merge_quantiles(F.col("startups")).alias("t"), *(reported(rows) if activity is None else []),
    )
    if activity is not None:
        by = [*f.keys, "cli_version"]
        counted = scoped(activity).groupBy(*by).agg(*reported(activity)).withColumnsRenamed({k: f"c_{k}" for k in by})
        made = made.join(counted, all_of([F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in by]), "left")
    out = made.select(
        *f.keys, "cli_version", "sessions", "size_reported", "least_size", "most_size", "startup_reported", read_quantile(F.col("s"), F.col("size_reported"), 0.5).alias("size_p50"),
        *(read_quantile(F.col("t"), F.col("startup_reported"), q).alias(f"startup_p{int(100 * q)}") for q in (0.5, 0.95)),
        *(F.coalesce(k, F.lit(0)).alias(k) for k in ("size_installs", "startup_installs")),
    )
    return f.page(out, *version_order(F.col("cli_version")))
