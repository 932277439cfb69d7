import pytest
from pyspark.sql import functions as F

from conftest import plain
from telemill import queries
from telemill.sources import telemetry

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, agree):
    agree(queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name, column", [("q12_version_sizes", "size_installs"), ("q12_version_sizes", "startup_installs"), ("q35_reach", "reached"), ("q35_reach", "active")])
def test_distinct_sketches_are_near_exact_counts(name, column, spark, duck):
    """1,500 installs: a sketch's standard error is about 1 %, so 4 % is met."""
    sf = "/root/testdata/sf0.1"
    key = [c for c in ("tenant_id", "cli_version") if c in queries.queries()[name](spark, sf).columns]
    got = {tuple(r[k] for k in key): r[column] for r in queries.queries()[name](spark, sf).collect()}
    cursor = duck.execute(SQL[name].replace("FROM events", f"FROM '{sf}/events.parquet'"))
    names = [d[0] for d in cursor.description]
    want = {tuple(r[k] for k in key): r[column] for r in (dict(zip(names, x)) for x in cursor.fetchall())}
    assert got.keys() == want.keys() and max(want.values()) > 500
    assert all(abs(got[k] - n) <= max(1, 0.04 * n) for k, n in want.items())


SKETCHED = {
    "q2_latency_percentiles": ("traces", "week", ("command_name",), {"p50": ("duration_ms", 0.5), "p95": ("duration_ms", 0.95), "p99": ("duration_ms", 0.99)}),
    "q11_resource_usage": ("traces", "month", ("command_name", "cli_version"), {"rss_p50": ("peak_rss_bytes", 0.5), "rss_p95": ("peak_rss_bytes", 0.95), "cpu_p50": ("cpu_time_ms", 0.5), "cpu_p95": ("cpu_time_ms", 0.95)}),
    "q12_version_footprint": ("logs", None, ("cli_version",), {"size_p50": ("binary_size_bytes", 0.5), "startup_p50": ("startup_ms", 0.5), "startup_p95": ("startup_ms", 0.95)}),
}


def test_every_query_has_sql_or_is_a_sketch():
    assert set(queries.queries()) - set(SQL) == set(SKETCHED)


@pytest.mark.parametrize("name", sorted(SKETCHED))
def test_sketched_percentiles_stand_at_their_ranks(name, spark):
    """In each group as many of the facts as the percentile says lie below it, within 3 % and two rows."""
    from collections import defaultdict
    from datetime import datetime

    fact, grain, dims, columns = SKETCHED[name]
    sf = "/root/testdata/sf0.01"
    facts = getattr(telemetry, fact)(spark, sf).filter((F.col("time") >= F.lit(datetime(2024, 1, 1))) & (F.col("time") < F.lit(datetime(2024, 2, 1))))
    facts = facts.filter("event_name = 'cli.session.started'") if fact == "logs" else facts
    keys = ["tenant_id", *dims] + ([F.date_trunc(grain, "time").alias("bucket")] if grain else [])
    held = defaultdict(list)
    used = sorted({c for c, _ in columns.values()})
    for r in facts.select(*keys, *used).collect():
        held[tuple(r[k] for k in ("tenant_id", *dims, *(["bucket"] if grain else [])))].append(r)
    out = queries.queries()[name](spark, sf).collect()
    assert len(out) == len(held)
    for r in out:
        group = held[tuple(r[k] for k in ("tenant_id", *dims, *(["bucket"] if grain else [])))]
        for c, (of, q) in columns.items():
            values = [x[of] for x in group if x[of] is not None]
            if not values:
                assert r[c] is None
                continue
            below, upto, slack = sum(v < r[c] for v in values), sum(v <= r[c] for v in values), 2 + 0.03 * len(values)
            assert below - slack <= q * len(values) <= upto + slack, (c, r)


EXACT = ["q12_version_sizes", "q35_reach", "q35_reach_groups", "q35_reach_series", "q36_counter_per_install", "q36_installs_per_session", "q36_invocations_per_install", "q8_active_installs", "r3_session_activity_daily"]


@pytest.fixture(scope="session")
def many_installs(spark, tmp_path_factory):
    """A day of 120,000 events, each of another user: more installs in a group than a sketch keeps one by one."""
    folder = tmp_path_factory.mktemp("many")
    rows = spark.range(120_000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 700_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "signup").otherwise("click").alias("event_type"), (F.col("id") % 500).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 97).alias("props"),
    )
    rows.coalesce(1).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", EXACT)
def test_distinct_counts_are_exact_where_sketches_estimate(name, spark, duck, many_installs):
    df = queries.queries()[name](spark, many_installs)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name].replace("FROM events", f"FROM '{many_installs}/events.parquet/*.parquet'"))
    names = [d[0] for d in cursor.description]
    want = [repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in cursor.fetchall()]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(want) and want


def test_error_trends_count_every_raised_error(spark):
    """Whatever its consent tier; first and last time, commands and a sample stand beside the trend."""
    sf = "/root/testdata/sf0.001"
    raised = telemetry.logs(spark, sf).filter("event_name = 'cli.error.raised'")
    out = queries.queries()["q30_error_trends"](spark, sf)
    assert out.agg(F.sum("events")).first()[0] == raised.count() > raised.filter("consent_tier <> 'full' or tenant_id = 't1'").count()
    assert {"first_seen", "last_seen", "commands", "sample"} <= set(out.columns)
