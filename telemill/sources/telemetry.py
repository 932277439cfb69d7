"""Telemetry facts derived from an `events` table: spans, log events and metric points of command-line tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import fingerprint
from ..functions.sketches import MEASURE_BOUNDS, VALUE_BOUNDS, one_hot

SPARK_SOURCE = """
SELECT event_id, user_id AS u, event_type, value,
  CAST(get_json_object(props, '$.k') AS INT) AS k,
  timestamp_micros(unix_micros(date_trunc('day', ts)) + (unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(date_trunc('day', ts))) div 12) AS t
FROM {events}
"""
DUCKDB_SOURCE = """
SELECT event_id, user_id AS u, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INT) AS k,
  make_timestamp(epoch_us(date_trunc('day', ts)) + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 12) AS t
FROM events
"""
# One text for both engines: SRC is the source above, STR the engine's text type.
LOGS = """
SELECT event_id, t, event_type, value, k, u,
  CASE WHEN u % 5 = 4 THEN 't1' ELSE 't0' END AS tenant_id,
  CASE WHEN u % 7 = 6 THEN NULL ELSE concat('i', CAST(u AS <STR>)) END AS install_id,
  CASE WHEN u % 7 = 6 THEN 'anonymous' WHEN u % 3 = 0 THEN 'full' ELSE 'basic' END AS consent_tier,
  CASE u % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS service_name,
  CASE k % 6 WHEN 0 THEN 'build' WHEN 1 THEN 'test' WHEN 2 THEN 'deploy' WHEN 3 THEN 'lint' WHEN 4 THEN 'status' END AS command_name,
  CASE WHEN k = 1 THEN 'dev' WHEN k = 0 THEN '1.0.0-rc.1'
       ELSE concat('1.', CAST(CAST(FLOOR((EXTRACT(DAY FROM t) + u % 14) / 7.0) AS INT) AS <STR>), '.0') END AS cli_version,
  CASE u % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'darwin' ELSE 'windows' END AS os,
  CASE u % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END AS arch,
  CASE u % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_ci,
  CASE WHEN k = 50 THEN NULL WHEN event_type = 'error' AND k % 10 = 0 THEN 130 WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
  CASE WHEN event_type = 'signup' THEN 'cli.session.started'
       WHEN event_type IN ('click', 'error') THEN 'cli.command.completed'
       WHEN event_type = 'purchase' AND k % 2 = 1 THEN 'cli.error.raised'
       WHEN event_type = 'purchase' THEN 'cli.command.invoked'
       WHEN k % 3 = 0 THEN 'cli.help.viewed' WHEN k % 3 = 1 THEN 'cli.command.unknown'
       ELSE 'cli.feature.activated' END AS event_name,
  CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k AS BIGINT) * 1048576 END AS peak_rss_bytes,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS BIGINT) * 10 END AS cpu_time_ms,
  CASE WHEN k % 4 = 1 THEN NULL ELSE CAST(k AS BIGINT) * 100000 + 1 END AS binary_size_bytes,
  CASE WHEN k % 5 = 2 THEN NULL ELSE CAST(k AS BIGINT) END AS startup_ms,
  CASE k % 4 WHEN 1 THEN 'network' WHEN 3 THEN 'timeout' END AS error_type,
  CASE k % 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'tls' END AS error_reason,
  CASE k % 3 WHEN 0 THEN concat('dial tcp 10.0.0.', CAST(k AS <STR>), ':443: connection refused')
             WHEN 1 THEN concat('open /home/u', CAST(u AS <STR>), '/x.yaml: permission denied')
             ELSE concat('retry ', CAST(k AS <STR>), ' of 5 failed after 30s') END AS error_message,
  CASE WHEN k % 7 = 0 THEN concat('run', CAST(k % 2 AS <STR>), ' run.go', chr(10), 'main main.go') END AS error_frames,
  CASE u % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'zsh' WHEN 2 THEN 'fish' ELSE '' END AS shell,
  k % 9 - 1 AS customized_count,
  CASE k % 5 WHEN 0 THEN 'build' WHEN 1 THEN 'test' WHEN 2 THEN 'hunter2' WHEN 3 THEN '' END AS suggestion,
  CASE k % 4 WHEN 0 THEN 'export' WHEN 1 THEN 'import' WHEN 2 THEN 'sync' ELSE '' END AS feature,
  CASE u % 4 WHEN 0 THEN 'brew' WHEN 1 THEN 'npm' WHEN 2 THEN 'curl' END AS install_method
FROM (<SRC>) s
"""
METRICS = """
SELECT event_id, t, tenant_id, install_id, service_name, command_name, cli_version, os, arch, is_ci,
  CASE event_type WHEN 'click' THEN 'cli.counter' WHEN 'view' THEN 'cli.measure' ELSE 'cli.value' END AS metric_name,
  CASE k % 3 WHEN 0 THEN 'vulns.found' WHEN 1 THEN 'scan.findings' ELSE 'other' END AS name,
  CASE WHEN k % 3 = 2 THEN NULL WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'bearer' WHEN k % 7 = 2 THEN 'other'
       ELSE concat('check=', CASE k % 2 WHEN 0 THEN 'bola' ELSE 'jwt' END, ';severity=', CASE k % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'info' END) END AS label,
  CASE k % 4 WHEN 0 THEN 'findings' WHEN 1 THEN 'hosts' END AS unit,
  CASE WHEN event_type = 'signup' THEN CAST(FLOOR(k / 10) * 3 AS DOUBLE) ELSE CAST(FLOOR(value) AS DOUBLE) END AS obs
FROM (<TEL>) tel
WHERE event_type IN ('click', 'view', 'signup')
"""


def duckdb_logs() -> str:
    return LOGS.replace("<SRC>", DUCKDB_SOURCE).replace("<STR>", "VARCHAR")


def duckdb_metrics() -> str:
    return METRICS.replace("<TEL>", "SELECT * FROM tel")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events, one row each: time, id, dimensions, and an `attributes` JSON beside the promoted columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tel = spark.sql(LOGS.replace("<SRC>", SPARK_SOURCE).replace("<STR>", "STRING"), events=events)
    given = {
        "cli.shell": "shell", "cli.suggestion": "suggestion", "cli.config.customized_count": "customized_count", "cli.terminal": "command_name",
        "cli.stdout.is_tty": "is_ci", "cli.runtime.name": "install_method", "cli.runtime.version": "cli_version", "cli.auth.state": "service_name",
    }
    attributes = F.to_json(F.struct(*(F.col(c).alias(k) for k, c in given.items())))
    frames, raised = F.coalesce(F.split("error_frames", "\n"), F.array().cast("array<string>")), F.col("event_name") == "cli.error.raised"
    stored = {
        "attributes": attributes, "top_frame": F.when(raised, F.get(frames, 0)), "error_fingerprint": F.when(raised, fingerprint(F.col("error_message"), frames)),
        "error_source": F.when(raised, F.when(F.size(frames) > 0, "stack").otherwise("message")),
    }
    return tel.withColumnsRenamed({"t": "time", "event_id": "id"}).withColumns(stored)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans: the completed commands, their duration in milliseconds."""
    done = logs(spark, sf_dir).filter("event_type in ('click', 'error')")
    return done.withColumn("span_name", F.concat(F.lit("cli.command."), F.coalesce("command_name", F.lit("")))).withColumn("duration_ms", F.col("value"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric points: counters hold value; measures and values hold one observation in its histogram bucket."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tel = LOGS.replace("<SRC>", SPARK_SOURCE).replace("<STR>", "STRING")
    met = spark.sql(METRICS.replace("<TEL>", tel), events=events).withColumnsRenamed({"t": "time", "event_id": "id"})
    bounds = lambda of: sum((F.when(F.col("obs") > b, 1).otherwise(0) for b in of), F.lit(0))
    at = F.when(F.col("metric_name") == "cli.measure", bounds(MEASURE_BOUNDS)).when(F.col("metric_name") == "cli.value", bounds(VALUE_BOUNDS))
    one = [F.lit(1).cast("long").alias("n"), *(F.col("obs").alias(c) for c in ("total", "least", "most"))]
    return met.withColumn("at", at).select("*", *one, *one_hot(F.col("at"), len(VALUE_BOUNDS) + 1)).drop("at")
