"""Sequences of runs: sessions by gaps, command sequences, retries, cold and warm runs, environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.buckets import bucket_of
from ..plans.scope import Filters, all_of, attribute, facts, json_number
from .installs import DONE

GAP, LONGEST, MOST_WINDOW = 30 * 60, 5, 3600
DIMS = ("cli_version", "os", "arch", "is_ci", "command_name")
LENGTHS = (("0", 1, 0), ("<1m", 2, 1), ("1-5m", 3, 60), ("5-15m", 4, 300), ("15-30m", 5, 900), ("30m+", 6, 1800))


def _micros(time: Column) -> Column:
    return F.unix_micros(time)


def sessionized(runs: DataFrame, gap: int = GAP) -> DataFrame:
    """Runs with a session number: one starts after more than the gap; an event at exactly the gap still belongs."""
    w = W.partitionBy("tenant_id", "install_id").orderBy("time", "id")
    starts = F.when(_micros(F.col("time")) - _micros(F.lag("time").over(w)) > gap * 1_000_000, 1).otherwise(0)
    return runs.withColumn("__new", starts).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def session_lengths(logs: DataFrame, f: Filters) -> DataFrame:
    """How many sessions have each length; all lengths are listed; the row without one has the total and the median."""
    spans = sessionized(facts(logs, f, *DIMS, events=(DONE,), install=True)).groupBy("tenant_id", "install_id", "session")
    secs = spans.agg(((_micros(F.max("time")) - _micros(F.min("time"))) / 1e6).alias("secs"))
    kind = F.when(F.col("secs") == 0, "0")
    for (name, _, _), (_, _, upper) in zip(LENGTHS[1:], [*LENGTHS[2:], ("", 0, 1 << 40)]):
        kind = kind.when(F.col("secs") < upper, name)
    rows = secs.withColumn("length", kind)
    counted = rows.groupingSets([[*f.keys, "length"], [*f.keys]], *f.keys, "length").agg(F.count("*").alias("sessions"), F.expr("percentile_cont(0.5) within group (order by secs)").alias("median_seconds"))
    lengths = F.inline(F.array(*[F.struct(F.lit(n).cast("string").alias("l"), F.lit(k).alias("position")) for n, k in (*((n, k) for n, k, _ in LENGTHS), (None, 7))]))
    # seven rows, of each tenant where it is every one
    every = (counted.select(*f.keys).distinct() if f.keys else logs.sparkSession.range(1)).select(*(F.col(k).alias(f"l_{k}") for k in f.keys), lengths)
    same = all_of([F.col("l").eqNullSafe(F.col("length")), *(F.col(k) == F.col(f"l_{k}") for k in f.keys)])
    out = every.join(counted, same, "left").drop(*f.keys).withColumnsRenamed({f"l_{k}": k for k in f.keys})
    return out.select(*f.keys, F.col("l").alias("length"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.when(F.col("l").isNull(), F.col("median_seconds")).alias("median_seconds"), "position").orderBy("position").drop("position")


def session_sequences(logs: DataFrame, f: Filters, least: int = 1) -> DataFrame:
    """The commonest starts of sessions: first five commands, repeats in a row folded."""
    runs = sessionized(facts(logs, f, *DIMS, events=(DONE,), install=True)).filter("command_name is not null")
    w = W.partitionBy("tenant_id", "install_id", "session").orderBy("time", "id")
    changed = runs.withColumn("b", F.lag("command_name").over(w)).filter(~F.col("b").eqNullSafe(F.col("command_name")))
    numbered = changed.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= LONGEST)
    joined = numbered.groupBy("tenant_id", "install_id", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "command_name"))), lambda x: x["command_name"]).alias("commands"))
    out = joined.filter(F.size("commands") >= least).groupBy(*f.keys, "commands").agg(F.count("*").alias("sessions"))
    return f.page(out, F.col("sessions").desc(), F.col("commands").asc())


def retries(logs: DataFrame, f: Filters, window: int = 600) -> DataFrame:
    """Per command what happened after failures: a chain is a run and what follows its failures within the window."""
    if not 0 < window <= MOST_WINDOW:
        raise ValueError("the retry window must be within an hour")
    near = window * 1_000_000
    rows = facts(logs, f, *DIMS, events=(DONE,), install=True).filter("command_name is not null and exit_code is not null")
    rows = rows.select(*f.keys, "install_id", "command_name", "time", "id", (F.col("exit_code") != 0).alias("failed"), _micros(F.col("time")).alias("us"))
    w = W.partitionBy(*f.keys, "install_id", "command_name").orderBy("time", "id")
    follows = F.lag("failed").over(w) & (F.col("us") - F.lag("us").over(w) <= near)
    chained = rows.select("*", F.lead("us").over(w).alias("next"), F.when(follows, 0).otherwise(1).alias("starts")).withColumn("chain", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    failures = W.partitionBy(*f.keys, "install_id", "command_name", "chain", "failed").orderBy("time", "id")
    flagged = chained.select(
        *f.keys, "install_id", "command_name", "chain", "failed", (F.col("failed") & (F.col("next") - F.col("us") <= near)).alias("retried"),
        (F.col("failed") & (F.lead("us", 2).over(failures) - F.col("us") <= near)).alias("repeated"),
    )
    chains = flagged.groupBy(*f.keys, "install_id", "command_name", "chain").agg(
        F.count_if("failed").alias("failures"), F.count_if("retried").alias("retried"), F.count("*").alias("runs"), F.bool_or(~F.col("failed")).alias("recovered"), F.bool_or("repeated").alias("repeated")
    ).filter("failures > 0")
    out = chains.groupBy(*f.keys, "command_name").agg(
        F.sum("failures").alias("failed"), F.sum("retried").alias("retried"), F.count_if(F.col("runs") >= 2).alias("sequences"), F.count_if("recovered").alias("recovered"),
        F.count_distinct(F.when(F.col("repeated"), F.col("install_id"))).alias("repeated_installs"), F.max("failures").alias("longest_streak"),
    )
    return f.page(out.withColumn("retry_rate", F.col("retried") / F.col("failed")), F.col("failed").desc(), F.col("command_name").asc())


def cold_runs(logs: DataFrame, installs: DataFrame, changes: DataFrame, f: Filters) -> DataFrame:
    """Completed runs with is_cold: the install's first ever, or the first at or after a change of version.

    A forward as-of join in one shuffle: version changes and runs are sorted together per install, and a run
    is the first after a change if the number of changes has risen since the run before.
    """
    runs = logs.filter(all_of([f.tenant(), F.col("time") < F.lit(f.end), F.col("event_name") == DONE, F.col("install_id").isNotNull()]))
    marks = changes.filter(f.tenant() & (F.col("changed_at") < F.lit(f.end))).select("tenant_id", "install_id", F.col("changed_at").alias("time"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("mark"))
    both = runs.select("tenant_id", "install_id", "time", "id", F.lit(0).alias("mark")).unionByName(marks)
    w = W.partitionBy("tenant_id", "install_id").orderBy("time", F.col("mark").desc(), "id")
    marked = both.withColumn("n", F.sum("mark").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("mark = 0")
    order = W.partitionBy("tenant_id", "install_id").orderBy("time", "id")
    first = installs.filter(f.tenant()).select("tenant_id", "install_id", "first_command_at")
    risen = marked.withColumn("after", F.col("n") > F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("k", F.row_number().over(W.partitionBy("tenant_id", "install_id", "time").orderBy("id")))
    cold = risen.join(first, ["tenant_id", "install_id"], "left").select("tenant_id", "install_id", "id", "time", (F.col("after") | F.coalesce((F.col("k") == 1) & (F.col("time") == F.col("first_command_at")), F.lit(False))).alias("is_cold"))
    return runs.join(cold, ["tenant_id", "install_id", "id", "time"])


def cold_warm_latency(logs: DataFrame, installs: DataFrame, changes: DataFrame, f: Filters, grain: str, duration: str = "value") -> DataFrame:
    """Per bucket and command the cold and the warm runs and exact percentiles of their durations."""
    rows = facts(cold_runs(logs, installs, changes, f), f, *DIMS).filter(f"command_name is not null and {duration} >= 0")
    out = []
    for name, kind in (("cold", F.col("is_cold")), ("warm", ~F.col("is_cold"))):
        rows = rows.withColumn(f"__{name}", F.when(kind, F.col(duration)))
        out += [F.count(f"__{name}").alias(f"{name}_runs"), *(F.expr(f"percentile_cont({q}) within group (order by __{name})").alias(f"{name}_p{int(q * 100)}") for q in (0.5, 0.95, 0.99))]
    return f.page(rows.groupBy(*f.keys, bucket_of(grain, F.col("time")).alias("bucket"), "command_name").agg(*out), F.col("bucket").asc(), F.col("command_name").asc())


def session_environment(logs: DataFrame, f: Filters, value: Column, most: int = 10) -> DataFrame:
    """Sessions by a value of their environment: total, reported, the commonest values, and the rest as other."""
    rows = facts(logs, f, "cli_version", "os", "arch", "is_ci", events=("cli.session.started",)).select(*f.keys, value.alias("value"))
    counts = rows.groupBy(*f.keys, "value").agg(F.count("*").alias("sessions"))
    # one scan: everything else comes from the counts
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(*f.keys, F.col("value").isNull()).orderBy(F.col("sessions").desc(), "value")))
    kind = F.when(F.col("value").isNull(), None).when(F.col("rank") <= most, "value").otherwise("other")
    kinds = ranked.withColumn("kind", kind)
    listed = kinds.filter("kind = 'value'").select(*f.keys, "kind", "value", F.lit(1).cast("long").alias("n_values"), "sessions")
    rest = f.whole(kinds, F.count_if(F.col("kind") == "other").alias("n_values"), F.coalesce(F.sum(F.when(F.col("kind") == "other", F.col("sessions"))), F.lit(0)).alias("sessions"))
    total = f.whole(kinds, F.count("value").alias("n_values"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))
    reported = f.whole(kinds, F.count("value").alias("n_values"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("sessions"))), F.lit(0)).alias("sessions"))
    for name, part in (("other", rest), ("reported", reported), ("total", total)):
        listed = listed.unionByName(part.select(*f.keys, F.lit(name).alias("kind"), F.lit(None).cast("string").alias("value"), "n_values", "sessions"))
    return listed


def text_value(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def terminal_value(is_tty: Column) -> Column:
    return F.when(is_tty, "tty").when(~is_tty, "piped")



def environment_values() -> dict[str, Column]:
    """Each dimension's value of a session, from its attributes; null where it was not reported."""
    text = lambda k: F.nullif(attribute(k), F.lit(""))
    return {
        "shell": text("cli.shell"),
        "terminal": text("cli.terminal"),
        "stdout": terminal_value(F.when(attribute("cli.stdout.is_tty") == "true", True).when(attribute("cli.stdout.is_tty") == "false", False)),
        "runtime": text("cli.runtime.name"),
        # a version means nothing without its runtime
        "runtime_version": F.concat(text("cli.runtime.name"), F.lit(" "), text("cli.runtime.version")),
        "config": count_band(json_number("cli.config.customized_count")),
        "auth": text("cli.auth.state"),
    }


def count_band(c: str | Column) -> Column:
    """0, 1-2, 3-5 or 6+; a negative count is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 0, None).when(c == 0, "0").when(c <= 2, "1-2").when(c <= 5, "3-5").when(c > 5, "6+")
