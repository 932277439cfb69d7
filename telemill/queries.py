"""Every telemetry query over the given tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.messages import normalised
from .functions.versions import version_order
from .operators import commands, errors, installs, maintenance, sessions, vendor, vocabulary
from .operators.rollups import rollups
from .operators.stored import Stored
from .plans.buckets import stored_grain
from .plans.scope import EVERY, Filters, attribute, json_number
from .sources import telemetry

START, END = datetime(2024, 1, 1), datetime(2024, 2, 1)
WATERMARK = datetime(2024, 1, 20, 12)
#: Every tenant of the facts; a registered query holds each tenant's rows, as one tenant's query gives them.
TENANTS = ("t0", "t1")
Query = Callable[[SparkSession, str], DataFrame]

_WITH = f"WITH tel AS ({telemetry.duckdb_logs()}), met AS ({telemetry.duckdb_metrics()}),"
_SCOPE = "tenant_id = 't0' AND t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2024-02-01'"
_INSTALLS = """
ev AS (SELECT * FROM tel WHERE install_id IS NOT NULL),
installs AS (SELECT tenant_id, install_id, min(t) AS first_seen, max(t) AS last_seen, arg_min(coalesce(cli_version, '-'), (t, event_id)) AS first_version,
  arg_max(cli_version, (t, event_id)) FILTER (cli_version IS NOT NULL) AS last_version, arg_max(os, (t, event_id)) FILTER (os IS NOT NULL) AS last_os, arg_max(arch, (t, event_id)) FILTER (arch IS NOT NULL) AS last_arch,
  arg_max(install_method, (t, event_id)) FILTER (install_method IS NOT NULL) AS install_method,
  min(t) FILTER (event_name = 'cli.command.completed') AS first_command_at, min(t) FILTER (event_name = 'cli.command.completed' AND exit_code = 0) AS first_success_at
  FROM ev GROUP BY ALL),
seen AS (SELECT *, last_value(cli_version IGNORE NULLS) OVER w AS before_v, max(t) OVER w AS before_t FROM ev
  WINDOW w AS (PARTITION BY tenant_id, install_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sem AS (SELECT DISTINCT cli_version AS v, CASE WHEN cli_version = 'dev' THEN NULL WHEN cli_version = '1.0.0-rc.1' THEN 0 ELSE 1 + CAST(split_part(cli_version, '.', 2) AS INT) END AS k FROM tel),
changes AS (SELECT tenant_id, install_id, t AS changed_at, before_v AS from_version, cli_version AS to_version, CASE WHEN a.k < b.k THEN 'upgrade' ELSE 'downgrade' END AS direction
  FROM seen JOIN sem a ON a.v = before_v JOIN sem b ON b.v = cli_version WHERE before_v <> cli_version AND t > before_t AND a.k <> b.k),
found AS (SELECT tenant_id, install_id, 'feature' AS kind, feature AS name, min(t) AS first_at FROM ev WHERE event_name = 'cli.feature.activated' AND feature <> '' GROUP BY ALL),
"""
_COHORT = """cohort AS (SELECT * FROM installs WHERE tenant_id = 't0' AND first_seen >= TIMESTAMP '2024-01-01' AND first_seen < TIMESTAMP '2024-02-01'),
"""


def _sql(body: str, state: bool = False, scoped: bool = False) -> str:
    given = f"{_WITH}{_INSTALLS if state else ''}"
    if not scoped:
        return f"{given} q AS ({body}) SELECT * FROM q"
    one = f"(WITH {_COHORT if state else ''} q AS ({body}) SELECT 't0' AS tenant_id, * FROM q)"
    return f"{given[:-1] if given.endswith(',') else given.rstrip()[:-1]} " + " UNION ALL ".join(f"SELECT * FROM {one}".replace("'t0'", f"'{t}'") for t in TENANTS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class _Data:
    """The facts, rollups and states of one folder of tables, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, tenant: str = TENANTS[0], stored: Stored | None = None) -> None:
        self.spark, self.tenant, self.stored = spark, tenant, stored
        self.logs, self.traces, self.metrics = (lambda f=f: f(spark, sf_dir) for f in (telemetry.logs, telemetry.traces, telemetry.metrics))
        self.rules = rollups()

    @property
    def keys(self) -> tuple[str, ...]:
        return self.scope().keys

    def scope(self, limit: int = 1000, **more) -> Filters:
        return Filters(self.tenant, START, END, limit=limit, **more)

    def rolled(self, name: str, grain: str | None = None) -> DataFrame:
        r = self.rules[name]
        if self.stored is not None:
            return self.stored.read(name, grain or r.grain, START, END)
        made = r.build(getattr(self, r.fact)())
        return r.merge(made, grain) if grain and grain != r.grain else made

    def installs(self) -> DataFrame:
        return installs.install_states(self.logs())

    def changes(self) -> DataFrame:
        return installs.version_changes(self.logs())


_QUERIES: dict[str, Callable[[_Data], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _scoped(name: str) -> bool:
    """Is a query one tenant's, as against a table of all tenants?"""
    return name.startswith(("q", "f"))


def _query(name: str, sql: str | None = None, state: bool = False):
    def keep(f: Callable[[_Data], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = _sql(sql, state, _scoped(name))
        return f

    return keep


_B = lambda grain, t="t": f"date_trunc('{grain}', {t}) AS bucket"
_RUN = f"FROM tel WHERE {_SCOPE} AND event_type IN ('click', 'error')"
_SPAN = f"FROM tel WHERE {_SCOPE} AND event_type IN ('click', 'error') AND concat('cli.command.', coalesce(command_name, '')) LIKE 'cli.command.%'"

_query("q1_list_traces", f"SELECT event_id AS id, t AS time, span, duration_ms FROM (SELECT *, concat('cli.command.', coalesce(command_name, '')) AS span, value AS duration_ms {_RUN} AND os IN ('linux', 'darwin') AND shell LIKE '%sh%' AND regexp_matches(shell, '^(ba|z)sh$')) ORDER BY t DESC, event_id LIMIT 100")(
    lambda d: commands.list_traces(d.traces(), d.scope(100, systems=("linux", "darwin"), contains={"cli.shell": "sh"}, matches={"cli.shell": "^(ba|z)sh$"})).select(*d.keys, "id", "time", F.col("span_name").alias("span"), "duration_ms")
)
_query("q2_latency_percentiles")(lambda d: commands.latency_percentiles(d.rolled("command_stats", "day"), d.scope(), "week"))
_query("q2_latency_exact", f"SELECT {_B('week')}, command_name, count(*) AS invocations, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 {_SPAN} GROUP BY ALL")(
    lambda d: _rounded(commands.exact_latency_percentiles(d.traces(), d.scope(), "week"))
)
_query("q3_error_rate", f"SELECT {_B('day')}, command_name, count(*) AS invocations, count(*) FILTER (exit_code IS DISTINCT FROM 0) AS errors, round(count(*) FILTER (exit_code IS DISTINCT FROM 0) / count(*), 6) AS error_rate {_SPAN} GROUP BY ALL")(
    lambda d: _rounded(commands.error_rate(d.rolled("command_stats", "day"), d.scope(), "day"))
)
_query("q4_command_frequency", f"SELECT {_B('hour')}, command_name, count(*) AS invocations {_SPAN} AND os = 'linux' GROUP BY ALL ORDER BY 1, 2 NULLS LAST LIMIT 1000")(
    lambda d: commands.command_frequency(d.rolled("command_stats"), d.scope(systems=("linux",), limit=1000), "hour")
)
_query("q5_ci_split", f"SELECT {_B('month')}, is_ci, count(*) AS invocations {_SPAN} GROUP BY ALL")(lambda d: commands.ci_split(d.rolled("command_stats", "day"), d.scope(), "month"))
_query("q6_exit_codes", f"SELECT {_B('week')}, command_name, exit_code, count(*) AS invocations {_SPAN} GROUP BY ALL")(lambda d: commands.exit_codes(d.rolled("exit_codes"), d.scope(), "week"))
_STARTED = f"FROM tel WHERE {_SCOPE} AND event_name = 'cli.session.started'"
_query("q7_session_cohort", f"SELECT {_B('week')}, cli_version, os, arch, count(*) AS sessions {_STARTED} GROUP BY ALL")(lambda d: installs.session_cohort(d.rolled("session_activity"), d.scope(), "week"))
_query("q8_active_installs", f"SELECT {_B('day')}, count(DISTINCT install_id) AS installs {_STARTED} GROUP BY ALL")(lambda d: installs.active_installs(d.rolled("session_installs"), d.scope(), "day"))
_query("q9_retention", f"""SELECT cohort, period, count(*) AS installs, first_value(count(*)) OVER (PARTITION BY cohort ORDER BY period) AS cohort_size FROM
  (SELECT install_id, min(p) OVER (PARTITION BY install_id) AS cohort, date_diff('day', min(p) OVER (PARTITION BY install_id), p) // 7 AS period FROM
   (SELECT DISTINCT install_id, date_trunc('week', t) AS p {_STARTED} AND install_id IS NOT NULL)) GROUP BY cohort, period""")(lambda d: installs.retention(d.logs(), d.scope(), "week"))
_query("q10_list_dimensions", f"SELECT dimension, value FROM (SELECT DISTINCT unnest(['cli_version', 'os', 'arch', 'command_name']) AS dimension, unnest([cli_version, os, arch, command_name]) AS value FROM tel WHERE tenant_id = 't0' AND event_type IN ('click', 'error')) WHERE value IS NOT NULL")(
    lambda d: commands.list_dimensions(d.rolled("command_stats", "day"), d.scope())
)
_query("q11_resource_usage")(lambda d: commands.resource_usage(d.rolled("command_resources", "day"), d.scope(), "month"))
_query("q11_resource_reports", f"SELECT {_B('month')}, command_name, cli_version, count(peak_rss_bytes) AS rss_reported, count(cpu_time_ms) AS cpu_reported {_SPAN} GROUP BY ALL")(
    lambda d: commands.resource_usage(d.rolled("command_resources", "day"), d.scope(), "month").select(*d.keys, "bucket", "command_name", "cli_version", "rss_reported", "cpu_reported")
)
_query("q12_version_footprint")(lambda d: installs.version_footprint(d.rolled("session_footprint"), d.scope(), d.rolled("session_installs")))
_query("q12_version_sizes", f"SELECT cli_version, count(*) AS sessions, count(binary_size_bytes) AS size_reported, min(binary_size_bytes) AS least_size, max(binary_size_bytes) AS most_size, count(startup_ms) AS startup_reported, count(DISTINCT install_id) FILTER (binary_size_bytes IS NOT NULL) AS size_installs, count(DISTINCT install_id) FILTER (startup_ms IS NOT NULL) AS startup_installs {_STARTED} GROUP BY ALL")(
    lambda d: installs.version_footprint(d.rolled("session_footprint"), d.scope(), d.rolled("session_installs")).drop("size_p50", "startup_p50", "startup_p95")
)
_query("q13_install_funnel", f"SELECT {_B('day', 'first_seen')}, count(*) AS installs, count(first_command_at) AS ran_command, count(first_success_at) AS succeeded FROM cohort GROUP BY ALL", True)(lambda d: installs.install_funnel(d.installs(), d.scope(), "day"))
_SECS = "(epoch_us(first_success_at) - epoch_us(first_seen)) / 1e6"
_query("q14_install_activation", f"SELECT {_B('day', 'first_seen')}, count(*) AS cohort_size, count(first_success_at) AS activated, round(quantile_cont({_SECS}, 0.5), 6) AS p50_seconds, round(quantile_cont({_SECS}, 0.9), 6) AS p90_seconds FROM cohort GROUP BY ALL", True)(
    lambda d: _rounded(installs.install_activation(d.installs(), d.scope(), "day"))
)
_query("q15_version_changes", f"SELECT {_B('week', 'changed_at')}, from_version, to_version, direction, count(*) AS changes, count(DISTINCT install_id) AS installs FROM changes JOIN installs USING (tenant_id, install_id) WHERE tenant_id = 't0' AND changed_at < TIMESTAMP '2024-02-01' AND last_os IN ('linux', 'darwin') GROUP BY ALL", True)(
    lambda d: installs.version_change_series(d.changes(), d.installs(), d.scope(systems=("linux", "darwin"), limit=1000), "week")
)
_query("q16_install_coverage", f"SELECT {_B('day')}, count(*) AS sessions, count(install_id) AS with_install {_STARTED} GROUP BY ALL")(lambda d: installs.install_coverage(d.logs(), d.scope(), "day"))
_query("q17_install_methods", f"SELECT {_B('day', 'first_seen')}, install_method, count(*) AS installs FROM cohort GROUP BY ALL", True)(lambda d: installs.install_methods(d.installs(), d.scope(), "day"))
_query("q18_new_vs_returning", f"SELECT a.bucket, count(*) FILTER (date_trunc('day', first_seen) = a.bucket) AS new, count(*) FILTER (date_trunc('day', first_seen) < a.bucket) AS returning FROM (SELECT DISTINCT tenant_id, install_id, {_B('day')} {_STARTED} AND install_id IS NOT NULL) a JOIN installs USING (tenant_id, install_id) GROUP BY ALL", True)(
    lambda d: installs.new_vs_returning(d.logs(), d.installs(), d.scope(), "day")
)
_FOUND = "greatest((epoch_us(first_at) - epoch_us(first_seen)) / 1e6, 0)"
_query("q19_feature_discovery", f"SELECT kind, name, (SELECT count(*) FROM cohort) AS cohort_size, count(*) AS installs, count(*) FILTER ({_FOUND} <= 86400) AS within_1d, count(*) FILTER ({_FOUND} <= 7 * 86400) AS within_7d, count(*) FILTER ({_FOUND} <= 30 * 86400) AS within_30d, round(quantile_cont({_FOUND}, 0.5), 6) AS median_seconds FROM found JOIN cohort USING (tenant_id, install_id) GROUP BY kind, name", True)(
    lambda d: _rounded(installs.feature_discovery(d.installs(), installs.discoveries(d.logs()), d.scope()))
)
_SESSION = f"""(SELECT *, sum(n) OVER (PARTITION BY install_id ORDER BY t, event_id) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY install_id ORDER BY t, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n
  FROM tel WHERE {_SCOPE} AND event_name = 'cli.command.completed' AND install_id IS NOT NULL))"""
_query("q20_session_lengths", f"""SELECT l.length, coalesce(sessions, 0) AS sessions, CASE WHEN l.length IS NULL THEN round(median_seconds, 6) END AS median_seconds FROM (SELECT unnest(['0', '<1m', '1-5m', '5-15m', '15-30m', '30m+', NULL]) AS length) l LEFT JOIN
  (SELECT length, count(*) AS sessions, quantile_cont(secs, 0.5) AS median_seconds FROM (SELECT secs, CASE WHEN secs = 0 THEN '0' WHEN secs < 60 THEN '<1m' WHEN secs < 300 THEN '1-5m' WHEN secs < 900 THEN '5-15m' WHEN secs < 1800 THEN '15-30m' ELSE '30m+' END AS length
   FROM (SELECT (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS secs FROM {_SESSION} GROUP BY install_id, s)) GROUP BY GROUPING SETS ((length), ())) c ON l.length IS NOT DISTINCT FROM c.length""")(lambda d: _rounded(sessions.session_lengths(d.logs(), d.scope())))
_query("q21_session_sequences", f"""SELECT array_to_string(commands, ' > ') AS commands, count(*) AS sessions FROM (SELECT install_id, s, list(command_name ORDER BY t, event_id)[1:5] AS commands FROM
  (SELECT *, lag(command_name) OVER (PARTITION BY install_id, s ORDER BY t, event_id) AS b FROM {_SESSION} WHERE command_name IS NOT NULL) WHERE b IS DISTINCT FROM command_name GROUP BY install_id, s) WHERE len(commands) >= 1 GROUP BY commands ORDER BY sessions DESC, commands LIMIT 1000""")(
    lambda d: sessions.session_sequences(d.logs(), d.scope()).select(*d.keys, F.array_join("commands", " > ").alias("commands"), "sessions")
)


def _retries_sql(seconds: int) -> str:
    return f"""SELECT command_name, CAST(sum(failures) AS BIGINT) AS failed, CAST(sum(retried) AS BIGINT) AS retried, count(*) FILTER (runs >= 2) AS sequences, count(*) FILTER (recovered) AS recovered,
  count(DISTINCT install_id) FILTER (repeated) AS repeated_installs, max(failures) AS longest_streak, round(sum(retried) / sum(failures), 6) AS retry_rate FROM
  (SELECT install_id, command_name, chain, count(*) FILTER (failed) AS failures, count(*) FILTER (failed AND nt - t <= INTERVAL {seconds} SECOND) AS retried, count(*) AS runs, bool_or(NOT failed) AS recovered, bool_or(failed AND third - t <= INTERVAL {seconds} SECOND) AS repeated FROM
   (SELECT *, lead(t, 2) OVER (PARTITION BY install_id, command_name, chain, failed ORDER BY t, event_id) AS third FROM
    (SELECT *, sum(st) OVER (PARTITION BY install_id, command_name ORDER BY t, event_id) AS chain FROM
     (SELECT install_id, command_name, t, event_id, exit_code <> 0 AS failed, lead(t) OVER w AS nt, CASE WHEN lag(exit_code <> 0) OVER w AND t - lag(t) OVER w <= INTERVAL {seconds} SECOND THEN 0 ELSE 1 END AS st
      FROM tel WHERE {_SCOPE} AND event_name = 'cli.command.completed' AND install_id IS NOT NULL AND command_name IS NOT NULL AND exit_code IS NOT NULL WINDOW w AS (PARTITION BY install_id, command_name ORDER BY t, event_id))))
   GROUP BY ALL) WHERE failures > 0 GROUP BY command_name"""


_query("q22_retries", _retries_sql(600))(lambda d: _rounded(sessions.retries(d.logs(), d.scope())))
_query("q22_retries_hour", _retries_sql(3600))(lambda d: _rounded(sessions.retries(d.logs(), d.scope(), 3600)))
_query("q23_cold_warm_latency", f"""SELECT date_trunc('week', t) AS bucket, command_name, count(*) FILTER (cold) AS cold_runs, {', '.join(f"round(quantile_cont(value, {q}) FILTER (cold), 6) AS cold_p{int(q * 100)}" for q in (.5, .95, .99))},
  count(*) FILTER (NOT cold) AS warm_runs, {', '.join(f"round(quantile_cont(value, {q}) FILTER (NOT cold), 6) AS warm_p{int(q * 100)}" for q in (.5, .95, .99))} FROM
  (SELECT r.*, event_id IN (SELECT cold_id FROM (SELECT r2.event_id AS cold_id FROM changes c, LATERAL (SELECT event_id FROM ev e WHERE e.tenant_id = c.tenant_id AND e.install_id = c.install_id AND event_name = 'cli.command.completed' AND e.t >= c.changed_at ORDER BY e.t, e.event_id LIMIT 1) r2 WHERE c.tenant_id = 't0'
    UNION ALL SELECT min(event_id) FROM ev e JOIN installs i USING (tenant_id, install_id) WHERE tenant_id = 't0' AND event_name = 'cli.command.completed' AND e.t = i.first_command_at GROUP BY install_id)) AS cold
   FROM ev r WHERE {_SCOPE} AND event_name = 'cli.command.completed' AND command_name IS NOT NULL AND value >= 0) GROUP BY ALL""", True)(
    lambda d: _rounded(sessions.cold_warm_latency(d.logs(), d.installs(), d.changes(), d.scope(), "week"))
)


def _environment_sql(value: str, most: int) -> str:
    return f"""SELECT * FROM (WITH v AS (SELECT {value} AS value {_STARTED}), c AS (SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) AS r FROM v WHERE value IS NOT NULL GROUP BY value)
  SELECT 'value' AS kind, value, CAST(1 AS BIGINT) AS n_values, n AS sessions FROM c WHERE r <= {most} UNION ALL SELECT 'other', NULL, count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE r > {most}
  UNION ALL SELECT 'reported', NULL, count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM c UNION ALL SELECT 'total', NULL, count(DISTINCT value), count(*) FROM v)"""


_query("q24_environment_shell", _environment_sql("nullif(shell, '')", 2))(lambda d: sessions.session_environment(d.logs(), d.scope(), sessions.text_value("shell"), 2))
_query("q24_environment_config", _environment_sql("CASE WHEN customized_count < 0 THEN NULL WHEN customized_count = 0 THEN '0' WHEN customized_count <= 2 THEN '1-2' WHEN customized_count <= 5 THEN '3-5' ELSE '6+' END", 10))(
    lambda d: sessions.session_environment(d.logs(), d.scope(), sessions.count_band("customized_count"), 10)
)
_ENVIRONMENT = {
    "terminal": "nullif(command_name, '')", "stdout": "CASE WHEN is_ci THEN 'tty' WHEN NOT is_ci THEN 'piped' END", "runtime": "nullif(install_method, '')",
    "runtime_version": "CASE WHEN install_method IS NOT NULL AND cli_version IS NOT NULL THEN concat(install_method, ' ', cli_version) END", "auth": "nullif(service_name, '')",
}
for _name, _value in _ENVIRONMENT.items():
    _query(f"q24_environment_{_name}", _environment_sql(_value, 2))(lambda d, n=_name: sessions.session_environment(d.logs(), d.scope(), sessions.environment_values()[n], 2))
_query("f13_typed_json", f"SELECT CASE WHEN customized_count < 0 THEN 'negative' ELSE 'number' END AS kind, count(*) AS n, CAST(sum(customized_count) AS DOUBLE) AS total FROM tel WHERE {_SCOPE} AND customized_count IS NOT NULL GROUP BY 1 UNION ALL SELECT 'text', count(*), 0 FROM tel WHERE {_SCOPE} AND shell IS NOT NULL")(
    lambda d: d.logs().filter(d.scope().tenant() & d.scope().time("time")).select(*d.keys, F.explode(F.array(
        F.struct(F.when(json_number("cli.config.customized_count") < 0, "negative").when(json_number("cli.config.customized_count").isNotNull(), "number").alias("kind"), json_number("cli.config.customized_count").alias("v")),
        F.struct(F.when(json_number("cli.shell").isNull() & attribute("cli.shell").isNotNull(), "text").alias("kind"), F.lit(0.0).alias("v")),
    )).alias("x")).filter("x.kind is not null").groupBy(*d.keys, "x.kind").agg(F.count("*").alias("n"), F.sum("x.v").alias("total"))
)
_query("q25_unknown_commands", f"SELECT coalesce(a.bucket, i.bucket) AS bucket, coalesce(a.n, 0) AS attempts, coalesce(i.n, 0) AS invocations, CASE WHEN coalesce(i.n, 0) > 0 THEN round(coalesce(a.n, 0) / i.n, 6) ELSE 0 END AS attempt_rate FROM (SELECT {_B('day')}, count(*) AS n FROM tel WHERE {_SCOPE} AND event_name = 'cli.command.unknown' GROUP BY ALL) a FULL JOIN (SELECT {_B('day')}, count(*) AS n {_SPAN} GROUP BY ALL) i ON a.bucket = i.bucket")(
    lambda d: _rounded(commands.unknown_commands(d.logs(), d.rolled("command_stats", "day"), d.scope(), "day"))
)
_query("q26_unknown_suggestions", f"SELECT * FROM (WITH a AS (SELECT nullif(suggestion, '') AS s, count(*) AS n FROM tel WHERE {_SCOPE} AND event_name = 'cli.command.unknown' AND suggestion <> '' GROUP BY 1), l AS (SELECT * FROM a WHERE s IN (SELECT command_name {_SPAN}) ORDER BY n DESC, s LIMIT 1) SELECT 'value' AS kind, s AS suggestion, n AS attempts, CAST(1 AS BIGINT) AS suggestions FROM l UNION ALL SELECT 'other', NULL, CAST((SELECT sum(n) FROM a) - (SELECT sum(n) FROM l) AS BIGINT), (SELECT count(*) FROM a) - (SELECT count(*) FROM l))")(
    lambda d: commands.unknown_suggestions(d.logs(), d.rolled("command_stats", "day"), d.scope(limit=1))
)
_query("q27_friction", f"SELECT coalesce(a.bucket, h.bucket) AS bucket, CASE WHEN a.bucket IS NULL THEN h.command_name ELSE a.command_name END AS command_name, coalesce(invocations, 0) AS invocations, coalesce(interrupted, 0) AS interrupted, coalesce(help_views, 0) AS help_views FROM (SELECT {_B('week')}, command_name, count(*) AS invocations, count(*) FILTER (exit_code = 130) AS interrupted {_SPAN} GROUP BY ALL) a FULL JOIN (SELECT {_B('week')}, command_name, count(*) AS help_views FROM tel WHERE {_SCOPE} AND event_name = 'cli.help.viewed' GROUP BY ALL) h ON a.bucket = h.bucket AND a.command_name IS NOT DISTINCT FROM h.command_name")(
    lambda d: commands.friction(d.rolled("exit_codes"), d.logs(), d.scope(), "week")
)
_RAISED = f"FROM tel WHERE {_SCOPE} AND event_name = 'cli.error.raised'"
_query("q28_error_types", f"SELECT {_B('week')}, command_name, error_type, count(*) AS errors {_RAISED} GROUP BY ALL")(lambda d: errors.error_types(d.logs(), d.scope(), "week"))
_query("q29_error_reasons", f"SELECT {_B('month')}, command_name, error_type, error_reason, count(*) AS errors {_RAISED} GROUP BY ALL")(lambda d: errors.error_reasons(d.logs(), d.scope(), "month"))
_PLAIN = "CASE k % 3 WHEN 0 THEN 'dial tcp <n>: connection refused' WHEN 1 THEN 'open <path>: permission denied' ELSE 'retry <n> of <n> failed after <n>' END"
_FP = f"left(sha256(CASE WHEN error_frames IS NOT NULL THEN concat('v1', chr(10), 'stack', chr(10), error_frames) ELSE concat('v1', chr(10), 'message', chr(10), {_PLAIN}) END), 16)"
#: Each tenant's own ceiling.
CEILINGS = {"t0": "basic", "t1": "full"}


def _fingerprints(d: _Data, ceilings: dict[str, str]) -> DataFrame:
    tenants = d.spark.createDataFrame(list(ceilings.items()), "tenant_id string, tier_ceiling string")
    return errors.error_fingerprints(d.logs(), tenants, d.scope(), "week")


_READ = f"{_RAISED} AND (consent_tier IN ('anonymous', 'basic') OR tenant_id = 't1' AND consent_tier = 'full')"
_query("q30_error_fingerprints", f"""SELECT {_FP} AS fp, count(*) AS events, count(DISTINCT install_id) AS installs, min(t) AS first_seen, max(t) AS last_seen,
  coalesce(array_to_string(list_sort(list(DISTINCT command_name) FILTER (command_name IS NOT NULL)), ','), '') AS commands, CASE WHEN any_value(error_frames) IS NULL THEN 'message' ELSE 'stack' END AS source,
  arg_max({_PLAIN}, (t, event_id)) AS message, split_part(any_value(error_frames), chr(10), 1) AS top_frame {_READ} GROUP BY 1""")(
    lambda d: _fingerprints(d, CEILINGS).select(*d.keys, "fp", "events", "installs", "first_seen", "last_seen", "commands", "source", "message", "top_frame")
)
# every tier of every tenant: all raised errors
_query("q30_error_trends", f"""SELECT p.*, trend, versions FROM
  (SELECT {_FP} AS fp, count(*) AS events, count(DISTINCT install_id) AS installs, min(t) AS first_seen, max(t) AS last_seen, coalesce(array_to_string(list_sort(list(DISTINCT command_name) FILTER (command_name IS NOT NULL)), ','), '') AS commands, arg_max({_PLAIN}, (t, event_id)) AS sample {_RAISED} GROUP BY 1) p
  JOIN (SELECT fp, string_agg(concat(strftime(b, '%Y-%m-%d %H'), ':', n, ':', i), ';' ORDER BY b) AS trend FROM (SELECT {_FP} AS fp, date_trunc('week', t) AS b, count(*) AS n, count(DISTINCT install_id) AS i {_RAISED} GROUP BY 1, 2) GROUP BY fp) USING (fp)
  JOIN (SELECT fp, string_agg(v, ',' ORDER BY sem.k NULLS LAST) AS versions FROM (SELECT DISTINCT {_FP} AS fp, cli_version AS v {_RAISED}) JOIN sem USING (v) GROUP BY fp) USING (fp)""", True)(
    lambda d: _fingerprints(d, dict.fromkeys(TENANTS, "full")).select(*d.keys, "fp", "events", "installs", "first_seen", "last_seen", "commands", F.col("message").alias("sample"), "trend", "versions")
)
_query("s21_normalised_messages", f"SELECT {_PLAIN} AS message, count(*) AS n FROM tel GROUP BY 1")(lambda d: d.logs().groupBy(normalised(F.col("error_message")).alias("message")).agg(F.count("*").alias("n")))

_MET = lambda m: f"FROM met WHERE {_SCOPE} AND metric_name = '{m}'"
_query("q31_counters", f"SELECT name, sum(obs) AS total, count(*) AS points, count(DISTINCT label) AS labels {_MET('cli.counter')} GROUP BY name")(lambda d: vendor.counters(d.rolled("counters", "day"), d.scope()))
_query("q32_counter_series", f"SELECT {_B('day')}, sum(obs) AS total, count(*) AS points {_MET('cli.counter')} AND name = 'vulns.found' AND regexp_extract(label, '(?:^|;)check=([^;]*)', 1) = 'bola' GROUP BY ALL")(
    lambda d: vendor.counter_series(d.rolled("counters", "day"), d.scope(where={"check": ("bola",)}), "vulns.found", "day")
)
_query("q32_counter_labels", f"SELECT label, sum(obs) AS total, count(*) AS points {_MET('cli.counter')} AND name = 'vulns.found' GROUP BY label")(lambda d: vendor.counter_labels(d.rolled("counters", "day"), d.scope(), "vulns.found"))
_query("q32_counter_labels_within", f"SELECT label, sum(obs) AS total, count(*) AS points {_MET('cli.counter')} AND name = 'vulns.found' AND regexp_extract(label, '(?:^|;)check=([^;]*)', 1) = 'bola' GROUP BY label")(
    lambda d: vendor.counter_labels(d.rolled("counters", "day"), d.scope(where={"check": ("bola",)}, label="bearer"), "vulns.found")
)
_query("q32_counter_label_series", f"SELECT {_B('day')}, sum(obs) AS total, count(*) AS points {_MET('cli.counter')} AND name = 'vulns.found' AND label = 'bearer' GROUP BY ALL")(
    lambda d: vendor.counter_series(d.rolled("counters", "day"), d.scope(label="bearer"), "vulns.found", "day")
)
_query("q33_measure_labels_within", f"SELECT label, count(*) AS n, sum(obs) AS total {_MET('cli.measure')} AND name = 'vulns.found' AND regexp_extract(label, '(?:^|;)severity=([^;]*)', 1) IN ('high', 'low') GROUP BY label")(
    lambda d: vendor.measure_labels(d.rolled("measures", "day"), d.scope(where={"severity": ("high", "low")}), "vulns.found")
)
_query("q34_value_labels_within", f"SELECT label, count(*) AS n, sum(obs) AS total {_MET('cli.value')} AND name = 'vulns.found' AND regexp_extract(label, '(?:^|;)severity=([^;]*)', 1) = 'info' GROUP BY label")(
    lambda d: vendor.value_labels(d.rolled("values", "day"), d.scope(where={"severity": ("info",)}), "vulns.found")
)
_query("q32_counter_groups", f"SELECT CASE WHEN label = 'other' THEN 'other' ELSE nullif(regexp_extract(label, '(?:^|;)check=([^;]*)', 1), '') END AS d0, CASE WHEN label = 'other' THEN 'other' ELSE nullif(regexp_extract(label, '(?:^|;)severity=([^;]*)', 1), '') END AS d1, {_B('week')}, sum(obs) AS total {_MET('cli.counter')} AND name = 'vulns.found' GROUP BY ALL")(
    lambda d: vendor.counter_groups(d.rolled("counters", "day"), d.scope(), "vulns.found", "week", ("check", "severity"))
)


_query("q32_counter_top_group", f"SELECT * FROM (WITH g AS (SELECT CASE WHEN label = 'other' THEN 'other' ELSE nullif(regexp_extract(label, '(?:^|;)check=([^;]*)', 1), '') END AS d0, {_B('week')}, obs {_MET('cli.counter')} AND name = 'vulns.found'), top AS (SELECT d0 FROM g GROUP BY d0 ORDER BY sum(obs) DESC, d0 NULLS LAST LIMIT 1) SELECT d0, bucket, sum(obs) AS total FROM g WHERE d0 IS NOT DISTINCT FROM (SELECT d0 FROM top) GROUP BY ALL)")(
    lambda d: vendor.counter_groups(d.rolled("counters", "day"), d.scope(limit=1), "vulns.found", "week", ("check",))
)
_query("q33_measure_labels", f"SELECT label, count(*) AS n, sum(obs) AS total {_MET('cli.measure')} AND name = 'vulns.found' GROUP BY label")(lambda d: vendor.measure_labels(d.rolled("measures", "day"), d.scope(), "vulns.found"))
_query("q34_value_labels", f"SELECT label, count(*) AS n, sum(obs) AS total {_MET('cli.value')} AND name = 'vulns.found' GROUP BY label")(lambda d: vendor.value_labels(d.rolled("values", "day"), d.scope(), "vulns.found"))
_query("q35_reach_groups", f"SELECT CASE WHEN label = 'other' THEN 'other' ELSE nullif(regexp_extract(label, '(?:^|;)severity=([^;]*)', 1), '') END AS d0, count(DISTINCT install_id) AS reached {_MET('cli.counter')} AND name = 'vulns.found' GROUP BY 1")(
    lambda d: vendor.reach_groups(d.rolled("counter_installs", "day"), d.scope(), "vulns.found", ("severity",))
)


def _histogram_sql(metric: str, bounds: tuple[int, ...], qs: tuple[float, ...], key: str, more: str, where: str = "") -> str:
    """Quantiles of bucketed observations: each key's first bucket at which the running count meets the rank."""
    at = " + ".join(f"CASE WHEN obs > {b} THEN 1 ELSE 0 END" for b in bounds)
    lows, highs = f"[{', '.join(map(str, bounds))}]", f"[{', '.join(map(str, bounds))}, NULL]"
    lo = f"CASE WHEN i = 0 THEN least ELSE {lows}[i] END"
    hi = f"CASE WHEN i = {len(bounds)} THEN greatest(most, {bounds[-1]}) ELSE {highs}[i + 1] END"
    reads = ", ".join(f"round(max(CASE WHEN cum >= {q} * n AND cum - c < {q} * n THEN greatest(least, least(most, {lo} + ({hi} - {lo}) * ({q} * n - (cum - c)) / c)) END), 6) AS p{int(q * 100)}".replace("least(most", "least(most") for q in qs)
    return f"""SELECT * FROM (WITH p AS (SELECT {key} AS key, {at} AS i, obs, label, coalesce(unit, '1') AS unit {_MET(metric)} {where}),
  a AS (SELECT key, max(unit) AS unit, count(*) AS n, sum(obs) AS total, min(obs) AS least, max(obs) AS most, count(DISTINCT label) AS labels, count(*) FILTER (i = 0) AS b0 FROM p GROUP BY key),
  c AS (SELECT key, i, c, sum(c) OVER (PARTITION BY key ORDER BY i) AS cum FROM (SELECT key, i, count(*) AS c FROM p GROUP BY key, i))
  SELECT {more}, n, total, least, most, {reads} FROM a JOIN c USING (key) GROUP BY ALL)"""


_query("q33_measures", _histogram_sql("cli.measure", telemetry.MEASURE_BOUNDS, (0.5, 0.95, 0.99), "name", "key AS name, labels"))(lambda d: _rounded(vendor.measures(d.rolled("measures", "day"), d.scope())))
_query("q33_measure_series", _histogram_sql("cli.measure", telemetry.MEASURE_BOUNDS, (0.5, 0.95, 0.99), "date_trunc('week', t)", "key AS bucket", "AND name = 'vulns.found'"))(
    lambda d: _rounded(vendor.measure_series(d.rolled("measures", "day"), d.scope(), "vulns.found", "week"))
)
_SEVERITY = "CASE WHEN label = 'other' THEN 'other' ELSE nullif(regexp_extract(label, '(?:^|;)severity=([^;]*)', 1), '') END"
_query("q33_measure_groups", _histogram_sql("cli.measure", telemetry.MEASURE_BOUNDS, (0.5, 0.95, 0.99), f"concat(coalesce({_SEVERITY}, '-'), '|', CAST(date_trunc('week', t) AS VARCHAR))", "nullif(split_part(key, '|', 1), '-') AS d0, CAST(split_part(key, '|', 2) AS TIMESTAMP) AS bucket", "AND name = 'vulns.found'"))(
    lambda d: _rounded(vendor.measure_groups(d.rolled("measures", "day"), d.scope(), "vulns.found", "week", ("severity",)))
)
_query("q34_value_groups", _histogram_sql("cli.value", telemetry.VALUE_BOUNDS, (0.5, 0.9, 0.99), f"concat(coalesce({_SEVERITY}, '-'), '|', CAST(date_trunc('week', t) AS VARCHAR))", "nullif(split_part(key, '|', 1), '-') AS d0, CAST(split_part(key, '|', 2) AS TIMESTAMP) AS bucket, unit, round(total / n, 6) AS mean, round(1 - b0 / n, 6) AS hit_rate", "AND name = 'vulns.found'"))(
    lambda d: _rounded(vendor.value_groups(d.rolled("values", "day"), d.scope(), "vulns.found", "week", ("severity",)))
)
_query("q34_values", _histogram_sql("cli.value", telemetry.VALUE_BOUNDS, (0.5, 0.9, 0.99), "name", "key AS name, unit, labels, round(total / n, 6) AS mean, round(1 - b0 / n, 6) AS hit_rate"))(lambda d: _rounded(vendor.values(d.rolled("values", "day"), d.scope())))
_SERIES = lambda key, bucket: _histogram_sql("cli.value", telemetry.VALUE_BOUNDS, (0.5, 0.9, 0.99), key, f"{bucket} AS bucket, unit, round(total / n, 6) AS mean, round(1 - b0 / n, 6) AS hit_rate", "AND name = 'vulns.found'")
_query("q34_value_series", _SERIES("date_trunc('week', t)", "key") + " UNION ALL " + _SERIES("0", "CAST(NULL AS TIMESTAMP)"))(lambda d: _rounded(vendor.value_series(d.rolled("values", "day"), d.scope(), "vulns.found", "week")))
_query("q35_reach", f"SELECT (SELECT count(DISTINCT install_id) {_MET('cli.counter')} AND name = 'vulns.found') AS reached, (SELECT count(DISTINCT install_id) {_STARTED}) AS active, (SELECT round(count(install_id) / count(*), 6) {_MET('cli.counter')} AND name = 'vulns.found') AS reported_share, round((SELECT count(DISTINCT install_id) {_MET('cli.counter')} AND name = 'vulns.found') / (SELECT count(DISTINCT install_id) {_STARTED}), 6) AS active_share")(
    lambda d: _rounded(vendor.reach(d.rolled("counter_installs", "day"), d.rolled("session_installs"), d.scope(), "vulns.found"))
)
_query("q35_reach_series", f"SELECT {_B('day')}, count(DISTINCT install_id) AS reached {_MET('cli.counter')} AND name = 'vulns.found' GROUP BY ALL")(lambda d: vendor.reach_series(d.rolled("counter_installs", "day"), d.scope(), "vulns.found", "day"))
_query("q36_ratio", f"SELECT bucket, coalesce(sum(a), 0) AS numerator, coalesce(sum(b), 0) AS denominator, round(CASE WHEN coalesce(sum(b), 0) <> 0 THEN coalesce(sum(a), 0) / sum(b) * 100 END, 6) AS value FROM (SELECT {_B('day')}, obs AS a, NULL AS b {_MET('cli.counter')} AND name = 'vulns.found' UNION ALL SELECT {_B('day')}, NULL, CAST(1 AS DOUBLE) {_STARTED}) GROUP BY GROUPING SETS ((bucket), ())")(
    lambda d: _rounded(
        vendor.ratio(
            vendor.operand(vendor._rows(d.rolled("counters", "day"), d.scope(), "vulns.found"), d.scope(), "total", "day", "day"),
            vendor.operand(d.rolled("session_activity").filter(d.scope().tenant()), d.scope(), "sessions", "day", "day"),
            100.0,
        )
    )
)


def _ratio_sql(above: tuple[str, str], below: tuple[str, str], grain: str, scale: int) -> str:
    side = lambda x: f"SELECT coalesce(CAST(bucket AS VARCHAR), '') AS k, bucket, CAST({x[0]} AS DOUBLE) AS v FROM (SELECT *, date_trunc('{grain}', t) AS bucket {x[1]}) GROUP BY GROUPING SETS ((bucket), ())"
    return f"SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.v, 0) AS numerator, coalesce(b.v, 0) AS denominator, round(CASE WHEN coalesce(b.v, 0) <> 0 THEN coalesce(a.v, 0) / b.v * {scale} END, 6) AS value FROM ({side(above)}) a FULL JOIN ({side(below)}) b USING (k)"


_NAMED = lambda m: f"{_MET(m)} AND name = 'vulns.found'"
#: kind -> its aggregate and rows, in SQL
_SIDES = {
    "counter_sum": ("sum(obs)", _NAMED("cli.counter")), "duration_count": ("count(*)", _NAMED("cli.measure")), "value_sum": ("sum(obs)", _NAMED("cli.value")), "value_count": ("count(*)", _NAMED("cli.value")),
    "invocations": ("count(*)", _SPAN), "sessions": ("count(*)", _STARTED), "active_installs": ("count(DISTINCT install_id)", _STARTED),
}
for _name, _above, _below, _grain, _scale in (
    ("counter_per_install", "counter_sum", "active_installs", "week", 1), ("installs_per_session", "active_installs", "sessions", "day", 100),
    ("mean_value", "value_sum", "value_count", "hour", 1), ("timed_invocations", "duration_count", "invocations", "day", 1000), ("invocations_per_install", "invocations", "active_installs", "month", 1),
):
    _query(f"q36_{_name}", _ratio_sql(_SIDES[_above], _SIDES[_below], _grain, _scale))(
        lambda d, a=_above, b=_below, g=_grain, x=_scale: _rounded(vendor.ratio_of(lambda n, g: d.rolled(n, stored_grain(g)), d.scope(), (a, "vulns.found"), (b, "vulns.found"), g, float(x)))
    )
_query("q37_vendor_services", "SELECT service_name, count(DISTINCT name) FILTER (metric_name = 'cli.counter') AS counters, count(DISTINCT name) FILTER (metric_name = 'cli.measure') AS measures, count(DISTINCT name) FILTER (metric_name = 'cli.value') AS \"values\" FROM met WHERE tenant_id = 't0' GROUP BY service_name")(
    lambda d: vendor.vendor_services({k: d.rolled(k, "day") for k in ("counters", "measures", "values")}, d.scope())
)
_query("q38_metric_definitions", "SELECT DISTINCT service_name, name, CASE metric_name WHEN 'cli.counter' THEN 'counter' WHEN 'cli.measure' THEN 'duration' ELSE 'value' END AS kind, coalesce(name = 'vulns.found' AND service_name = 'alpha' AND metric_name = 'cli.counter', false) AS declared, false AS deprecated FROM met WHERE tenant_id = 't0' AND t >= TIMESTAMP '2024-01-02' AND name <> 'other' AND service_name IS NOT NULL")(
    lambda d: vendor.metric_definitions(
        d.metrics().filter("name = 'vulns.found' and service_name = 'alpha'").select("tenant_id", "service_name", "name", F.lit("counter").alias("kind"), F.lit(None).cast("timestamp").alias("deprecated_at")).distinct(),
        vendor.metrics_in_use({k: d.rolled(k, "day") for k in vendor.KINDS.values()}, END), d.scope(),
    )
)


def _folds(d: _Data) -> DataFrame:
    points = d.metrics().filter("metric_name = 'cli.counter'").select("tenant_id", "name", "label", "time")
    rows, _, _ = vocabulary.capped_metrics(points, points.select("tenant_id", "name").limit(0), points.select("tenant_id", "name", "label").limit(0), 1, 2)
    cap = F.explode(F.array(F.when(F.col("name_folded"), F.lit("names")), F.when(F.col("label_folded"), F.lit("labels")))).alias("cap")
    return rows.select("tenant_id", F.lit("counter").alias("kind"), cap, F.to_date("time").alias("date")).filter("cap is not null").groupBy("tenant_id", "kind", "cap", "date").agg(F.count("*").alias("n"))


_query("q31_counter_overflow", """SELECT * FROM (WITH m AS (SELECT * FROM met WHERE metric_name = 'cli.counter'),
  nv AS (SELECT tenant_id AS vt, name AS vn FROM (SELECT tenant_id, name, row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, name) AS r FROM m WHERE name <> 'other' GROUP BY 1, 2) WHERE r <= 1),
  named AS (SELECT m.*, vn IS NULL AND name <> 'other' AS nf, CASE WHEN vn IS NOT NULL THEN label END AS kept FROM m LEFT JOIN nv ON vt = tenant_id AND vn = name),
  lv AS (SELECT tenant_id AS lt, kept AS ll FROM (SELECT tenant_id, kept, row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, kept) AS r FROM named WHERE kept <> 'other' GROUP BY 1, 2) WHERE r <= 2)
  SELECT count(*) FILTER (nf) AS names_folded, count(*) FILTER (kept IS NOT NULL AND kept <> 'other' AND ll IS NULL) AS labels_folded, CAST(0 AS BIGINT) AS dim_values_folded FROM named LEFT JOIN lv ON lt = tenant_id AND ll = kept WHERE tenant_id = 't0' AND t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2024-02-01')""")(
    lambda d: vendor.overflow(_folds(d), d.scope(), "counter")
)

_DIMS = "tenant_id, cli_version, os, arch, is_ci"
_query("r1_command_stats_hourly", f"SELECT {_B('hour')}, {_DIMS}, command_name, count(*) AS invocations, count(*) FILTER (exit_code IS DISTINCT FROM 0) AS errors FROM tel WHERE event_type IN ('click', 'error') GROUP BY ALL")(lambda d: d.rolled("command_stats").drop("durations"))
_query("r2_command_stats_daily", f"SELECT {_B('day')}, {_DIMS}, command_name, count(*) AS invocations, count(*) FILTER (exit_code IS DISTINCT FROM 0) AS errors FROM tel WHERE event_type IN ('click', 'error') GROUP BY ALL")(lambda d: d.rolled("command_stats", "day").drop("durations"))
_query("r3_session_activity_daily", f"SELECT {_B('day')}, {_DIMS}, count(*) AS sessions, count(DISTINCT install_id) AS installs FROM tel WHERE event_name = 'cli.session.started' GROUP BY ALL")(
    lambda d: d.rolled("session_installs").groupBy("bucket", *(c.strip() for c in _DIMS.split(","))).agg(F.sum("sessions").alias("sessions"), F.count_distinct("install_id").alias("installs"))
)
_query("r4_exit_codes_hourly", f"SELECT {_B('hour')}, {_DIMS}, command_name, exit_code, count(*) AS invocations FROM tel WHERE event_type IN ('click', 'error') GROUP BY ALL")(lambda d: d.rolled("exit_codes"))
_query("r6_command_resources_daily", f"SELECT {_B('day')}, {_DIMS}, command_name, count(*) AS invocations, count(peak_rss_bytes) AS rss_reported, count(cpu_time_ms) AS cpu_reported FROM tel WHERE event_type IN ('click', 'error') GROUP BY ALL")(
    lambda d: d.rolled("command_resources", "day").drop("rss", "cpu")
)
_query("r7_session_footprint_daily", f"SELECT {_B('day')}, {_DIMS}, count(*) AS sessions, count(binary_size_bytes) AS size_reported, min(binary_size_bytes) AS least_size, max(binary_size_bytes) AS most_size, count(startup_ms) AS startup_reported FROM tel WHERE event_name = 'cli.session.started' GROUP BY ALL")(
    lambda d: d.rolled("session_footprint").drop("sizes", "startups", "size_installs", "startup_installs")
)
_VENDOR = f"{_DIMS}, service_name, command_name, name, label"
for _name, _metric in (("counters", "cli.counter"), ("measures", "cli.measure"), ("values", "cli.value")):
    _n = "points" if _name == "counters" else "n"
    for _grain in ("hour", "day"):
        _query(f"r_{_name}_{_grain}", f"SELECT {_B(_grain)}, {_VENDOR}, sum(obs) AS total, count(*) AS {_n}, count(install_id) AS reported FROM met WHERE metric_name = '{_metric}' GROUP BY ALL")(
            lambda d, a=_name, g=_grain, n=_n: d.rolled(a, g).select("bucket", *(c.strip() for c in _VENDOR.split(",")), "total", n, "reported")
        )
_query("r14_live_command_stats", f"SELECT {_B('hour')}, {_DIMS}, command_name, count(*) AS invocations, count(*) FILTER (exit_code IS DISTINCT FROM 0) AS errors FROM tel WHERE event_type IN ('click', 'error') GROUP BY ALL")(
    lambda d: d.rules["command_stats"].live(d.rolled("command_stats").filter(F.col("bucket") < F.lit(WATERMARK)), d.traces(), WATERMARK).drop("durations")
)
_query("t4_install_states", "SELECT tenant_id, install_id, first_seen, last_seen, first_version, last_version, last_os, last_arch, install_method, first_command_at, first_success_at FROM installs", True)(lambda d: d.installs())
_query("t5_version_changes", "SELECT * FROM changes", True)(lambda d: d.changes())
_query("t6_discoveries", "SELECT * FROM found", True)(lambda d: installs.discoveries(d.logs()))
_query("t7_capped_reasons", """SELECT tenant_id, error_type, count(*) AS n, count(*) FILTER (folded) AS folded FROM (SELECT tenant_id, CASE WHEN error_type IS NOT NULL AND r > 1 THEN 'other' ELSE error_type END AS error_type, error_type IS NOT NULL AND r > 1 AS folded FROM tel LEFT JOIN
  (SELECT tenant_id AS vt, error_type AS ve, row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, error_type) AS r FROM tel WHERE error_type IS NOT NULL GROUP BY 1, 2) v ON vt = tenant_id AND ve = error_type) GROUP BY 1, 2""")(
    lambda d: (lambda rows: vocabulary.capped(rows, vocabulary.admitted(rows, rows.limit(0), ["tenant_id"], "error_type", 1), ["tenant_id"], "error_type").groupBy("tenant_id", "error_type").agg(F.count("*").alias("n"), F.count_if("__folded").alias("folded")))(d.logs().select("tenant_id", "error_type"))
)

def _capped_metrics(d: _Data) -> DataFrame:
    points = d.metrics().select("tenant_id", "name", "label")
    rows, _, _ = vocabulary.capped_metrics(points, points.select("tenant_id", "name").limit(0), points.limit(0), 1, 2)
    return rows.groupBy("tenant_id", "name", "label").agg(F.count("*").alias("n"), F.count_if("name_folded").alias("names_folded"), F.count_if("label_folded").alias("labels_folded"))


_query("t8_capped_metrics", """SELECT * FROM (WITH nv AS (SELECT tenant_id AS vt, name AS vn FROM (SELECT tenant_id, name, row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, name) AS r FROM met WHERE name <> 'other' GROUP BY 1, 2) WHERE r <= 1),
  named AS (SELECT tenant_id, CASE WHEN vn IS NULL THEN 'other' ELSE name END AS name, vn IS NULL AND name <> 'other' AS nf, CASE WHEN vn IS NOT NULL THEN label END AS label FROM met LEFT JOIN nv ON vt = tenant_id AND vn = name),
  lv AS (SELECT tenant_id AS lt, name AS ln, label AS ll FROM (SELECT tenant_id, name, label, row_number() OVER (PARTITION BY tenant_id, name ORDER BY count(*) DESC, label) AS r FROM named WHERE label <> 'other' GROUP BY 1, 2, 3) WHERE r <= 2),
  done AS (SELECT tenant_id, name, nf, label IS NOT NULL AND label <> 'other' AND ll IS NULL AS lf, CASE WHEN label IS NOT NULL AND ll IS NULL THEN 'other' ELSE label END AS label FROM named LEFT JOIN lv ON lt = tenant_id AND ln = name AND ll = label)
  SELECT tenant_id, name, label, count(*) AS n, count(*) FILTER (nf) AS names_folded, count(*) FILTER (lf) AS labels_folded FROM done GROUP BY ALL)""")(_capped_metrics)


def _capped_dimensions(d: _Data) -> DataFrame:
    points = d.metrics().select("tenant_id", "name", "label")
    known = points.select("tenant_id", "name", F.col("name").alias("key"), F.col("label").alias("value")).limit(0)
    rows, _ = vocabulary.capped_dimensions(points, known, 1)
    return rows.groupBy("tenant_id", "name", "label").agg(F.count("*").alias("n"), F.count_if("dim_folded").alias("folded"))


_TOP = lambda c: f"(SELECT tenant_id AS t_{c}, name AS n_{c}, {c} AS top_{c} FROM (SELECT tenant_id, name, {c}, row_number() OVER (PARTITION BY tenant_id, name ORDER BY count(*) DESC, {c}) AS r FROM b WHERE {c} <> '' GROUP BY 1, 2, 3) WHERE r = 1) ON t_{c} = tenant_id AND n_{c} = name"
_query("t9_capped_dimensions", f"""SELECT * FROM (WITH b AS (SELECT tenant_id, name, label, regexp_extract(label, '(?:^|;)check=([^;]*)', 1) AS c, regexp_extract(label, '(?:^|;)severity=([^;]*)', 1) AS s FROM met),
  j AS (SELECT tenant_id, name, CASE WHEN c <> '' THEN concat('check=', CASE WHEN c = top_c THEN c ELSE 'other' END, ';severity=', CASE WHEN s = top_s THEN s ELSE 'other' END) ELSE label END AS label, coalesce(c <> '' AND (c <> top_c OR s <> top_s), false) AS f
    FROM b LEFT JOIN {_TOP('c')} LEFT JOIN {_TOP('s')})
  SELECT tenant_id, name, label, count(*) AS n, count(*) FILTER (f) AS folded FROM j GROUP BY ALL)""")(_capped_dimensions)

_TODAY, _CUTOFF = date(2024, 1, 30), datetime(2024, 1, 30, 1, 50)
_query("m3_retained_logs", "SELECT tenant_id, count(*) AS n, min(t) AS first FROM tel WHERE CAST(t AS DATE) >= DATE '2024-01-30' - CASE tenant_id WHEN 't1' THEN 5 ELSE 14 END GROUP BY tenant_id")(
    lambda d: maintenance.within_retention(d.logs(), d.logs().select("tenant_id", F.when(F.col("tenant_id") == "t1", 5).alias("log_days")).distinct(), "log_days", _TODAY, 14)
    .groupBy("tenant_id").agg(F.count("*").alias("n"), F.min("time").alias("first"))
)


def _swept(d: _Data) -> DataFrame:
    kept = maintenance.sweep_state(d.installs(), d.changes(), installs.discoveries(d.logs()), _CUTOFF)
    counts = [x.select("tenant_id", F.lit(kind).alias("kind")).groupBy("tenant_id", "kind").agg(F.count("*").alias("n")) for x, kind in zip(kept, ("installs", "changes", "discoveries"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_query("m4_swept_state", """SELECT * FROM (WITH alive AS (SELECT tenant_id, install_id FROM installs WHERE last_seen >= TIMESTAMP '2024-01-30 01:50:00')
  SELECT tenant_id, 'installs' AS kind, count(*) AS n FROM alive GROUP BY 1 UNION ALL SELECT tenant_id, 'changes', count(*) FROM changes JOIN alive USING (tenant_id, install_id) WHERE changed_at >= TIMESTAMP '2024-01-30 01:50:00' GROUP BY 1
  UNION ALL SELECT tenant_id, 'discoveries', count(*) FROM found JOIN alive USING (tenant_id, install_id) GROUP BY 1)""", True)(_swept)
_query("x10_versions", "SELECT v AS cli_version, CAST(row_number() OVER (ORDER BY k NULLS LAST) AS INT) AS position FROM (SELECT DISTINCT cli_version AS v, CASE WHEN cli_version = 'dev' THEN NULL WHEN cli_version = '1.0.0-rc.1' THEN 0 ELSE 1 + CAST(split_part(cli_version, '.', 2) AS INT) END AS k FROM tel)")(
    lambda d: _positions(d.logs().select("cli_version").distinct())
)


def _positions(versions: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    # a handful of distinct versions
    return versions.withColumn("position", F.row_number().over(W.orderBy(*version_order(F.col("cli_version")))))


def _registered(name: str, f: Callable[[_Data], DataFrame]) -> Query:
    if not _scoped(name):
        return lambda spark, sf_dir: f(_Data(spark, sf_dir))
    # every tenant in one plan: each table is scanned as often as for one
    return lambda spark, sf_dir: f(_Data(spark, sf_dir, EVERY))


def queries() -> dict[str, Query]:
    return {name: _registered(name, f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
