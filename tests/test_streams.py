"""State between micro-batches, capped vocabularies of several writers, dirty dates, stored rollups, retention by tenant."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telemill import queries
from telemill.operators import ingest, installs, maintenance
from telemill.operators.rollups import rollups
from telemill.operators.stored import Stored
from telemill.operators.vocabulary import OTHER, Vocabulary
from telemill.sources import otlp, telemetry
from telemill.sources.snapshots import Snapshot
from telemill.streaming.jobs import Telemetry

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 3, 1, 12)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# --- snapshots


def test_snapshot_versions_and_lost_races(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"), "k string, v int", ("k",), most_folders=3)
    make = lambda *xs: spark.createDataFrame(list(xs), "k string, v int")
    assert s.version() == -1 and s.read().count() == 0 and s.holding("x", 0) is None
    assert s.publish(make(("a", 1), ("b", 2)), -1, "x", 0)
    # another writer has planned on the empty table too: it must not win, and leaves no rows behind
    assert not s.publish(make(("c", 9)), -1, "y", 0)
    assert rows(s.read()) == [("a", 1), ("b", 2)] and len(s.files.names(f"{s.path}/rows")) == 1
    planned = []

    def plan(state):
        planned.append(state.count())
        if len(planned) == 1:  # somebody publishes while this writer plans
            assert s.publish(make(("b", 7)), s.version(), "y", 0)
        return make(("a", planned[-1] * 10))

    at = s.changed(plan, "x", 1)
    assert (planned, at, rows(s.read())) == ([2, 2], 2, [("a", 20), ("b", 7)])
    assert s.changed(plan, "x", 1) == at and len(planned) == 2  # held already
    assert (s.before("x", 1), s.before("x", 2), s.holding("x", 0)) == (1, 2, 0)
    assert rows(s.read(0)) == [("a", 1), ("b", 2)]
    for k in range(5):  # deltas are merged into a whole table now and then
        assert s.publish(make((f"n{k}", k)), s.version())
    assert s.read().count() == 7 and len(s._marker(s.version())["folders"]) <= 3
    s.prune(1)
    assert s.read().count() == 7 and len(s.versions()) == 1


# --- installs in batches

LOG = "tenant_id string, install_id string, time timestamp, id long, event_name string, exit_code int, cli_version string, os string, arch string, install_method string, feature string, flags array<string>"


def events(spark):
    logs = telemetry.logs(spark, SF)
    return logs.withColumn("flags", F.when(F.col("event_name") == "cli.command.invoked", F.array(F.lit("--all"), F.col("shell")))).select(*[c.split()[0] for c in LOG.split(", ")])


def test_states_carried_over_batches_equal_the_whole(spark, tmp_path):
    logs = events(spark).persist()
    job = Telemetry(spark, str(tmp_path / "t"), None, spark.createDataFrame([("t0",), ("t1",)], "tenant_id string"))
    edges = [datetime(2000, 1, 1), datetime(2024, 1, 6, 5), datetime(2024, 1, 13), datetime(2024, 1, 21, 17), datetime(2100, 1, 1)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        batch = logs.filter((F.col("time") >= F.lit(a)) & (F.col("time") < F.lit(b)))
        job._derive(batch, "logs", n)
        if n == 2:
            version = job.installs.version()
            job._derive(batch, "logs", n)  # runs again
            assert job.installs.version() == version
    names = installs.install_states(logs).columns
    assert rows(job.install_states(), *names) == rows(installs.install_states(logs), *names)
    changes = installs.version_changes(logs)
    assert rows(job.changes(), *changes.columns) == rows(changes) and changes.count() > 20
    # some of them span two batches: without the state before they would be missing
    alone = sum(installs.version_changes(logs.filter((F.col("time") >= F.lit(a)) & (F.col("time") < F.lit(b)))).count() for a, b in zip(edges, edges[1:]))
    assert alone < changes.count()
    found = installs.discoveries(logs, "flags")
    assert rows(job.discoveries.read(), *found.columns) == rows(found) and found.filter("kind = 'flag'").count() > 0


def test_marks_merge_in_any_order_and_late_events_change_nothing(spark):
    at = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    made = lambda *xs: spark.createDataFrame([("t", "i", at(m), n, "cli.command.completed", c, v, o, None, me, None, None) for n, m, c, v, o, me in xs], LOG)
    first, second = made((1, 10, 1, "1.0.0", "linux", ""), (2, 20, 0, None, None, "brew")), made((3, 5, 0, "0.9.0", "darwin", None), (4, 30, 0, "1.1.0", None, ""))
    a, b = installs.install_marks(first), installs.install_marks(second)
    whole = rows(installs.install_states(first.unionByName(second)))
    names = installs.install_states(first).columns
    assert rows(installs.states_of(installs.merge_marks(a, b)), *names) == rows(installs.states_of(installs.merge_marks(b, a)), *names) == whole
    assert whole[0][names.index("first_version")] == "0.9.0" and whole[0][names.index("install_method")] == "brew"
    # the late event of minute 5 is no change and none to change from
    got = rows(installs.version_changes(second, a), "from_version", "to_version", "direction")
    assert got == [("1.0.0", "1.1.0", "upgrade")]
    # a version that equals the state's, and events of an install without state
    assert installs.version_changes(made((5, 40, 0, "1.0.0", None, None)), a).count() == 0
    assert rows(installs.version_changes(second), "from_version", "to_version") == [("0.9.0", "1.1.0")]


# --- vocabularies


def test_two_writers_never_pass_a_cap(spark, tmp_path):
    v = Vocabulary(spark, str(tmp_path / "v"), ("tenant_id",), "word")
    other = Vocabulary(spark, str(tmp_path / "v"), ("tenant_id",), "word")
    batch = lambda *xs: spark.createDataFrame([("t", w) for w, n in xs for _ in range(n)], "tenant_id string, word string")
    at = F.lit(datetime(2024, 1, 1))
    raced = []
    plain = v.table.publish

    def slower(rows, on, *more, **named):  # the other writer publishes between this one's plan and its commit
        if not raced:
            raced.append(rows_of := sorted(r.word for r in rows.collect()))
            other.admit(batch(("x", 5), ("y", 4)), 3, at, "second", 0)
            assert rows_of == ["a", "b", "c"]
        return plain(rows, on, *more, **named)

    v.table.publish = slower
    known = v.admit(batch(("a", 9), ("b", 8), ("c", 7), (OTHER, 99)), 3, at, "first", 0)
    assert sorted(r.word for r in known.collect()) == ["a", "x", "y"] and raced
    # again: the same vocabulary, though another batch has been admitted since
    v.table.publish = plain
    other.admit(batch(("z", 1)), 10, at, "second", 1)
    assert sorted(r.word for r in v.admit(batch(("a", 9), ("b", 8), ("c", 7)), 3, at, "first", 0).collect()) == ["a", "x", "y"]
    assert v.known().count() == 4


def test_own_caps_and_last_seen(spark, tmp_path):
    from telemill.operators.vocabulary import cap_of

    v = Vocabulary(spark, str(tmp_path / "v"), ("tenant_id",), "word")
    tenants = spark.createDataFrame([("p", 1), ("q", None)], "tenant_id string, own int")
    batch = spark.createDataFrame([(t, w) for t in "pqr" for w in "abc"], "tenant_id string, word string")
    day = lambda n: F.lit(datetime(2024, 1, n))
    known = v.admit(batch, cap_of(F.col("own"), 2, 7), day(1), "s", 0, tenants)
    # a tenant's own cap, else the deployment's; one without configuration has that too
    assert rows(known, "tenant_id", "word") == [("p", "a"), ("q", "a"), ("q", "b"), ("r", "a"), ("r", "b")]
    later = v.admit(batch.filter("tenant_id = 'q'"), cap_of(F.col("own"), None, 3), day(3), "s", 1, tenants)
    seen = {(r.tenant_id, r.word): r.last_seen.day for r in later.collect()}
    assert seen == {("p", "a"): 1, ("q", "a"): 3, ("q", "b"): 3, ("q", "c"): 3, ("r", "a"): 1, ("r", "b"): 1}
    soon = v.admit(batch, cap_of(F.col("own"), 2, 7), F.lit(datetime(2024, 1, 3, 20)), "s", 2, tenants)
    assert {r.last_seen for r in soon.filter("tenant_id = 'q'").collect()} == {datetime(2024, 1, 3)}  # at most once a day
    v.sweep(F.lit(datetime(2024, 1, 3, 12)))
    assert rows(v.known(), "tenant_id") == [("p",), ("r",), ("r",)]


# --- rollups: stream, store, dirty dates


@pytest.mark.parametrize("name", ["command_resources", "command_stats", "counters", "exit_codes", "measures", "session_activity", "session_footprint", "values"])
def test_every_rollup_streams(spark, tmp_path, name):
    r = rollups()[name]
    facts = getattr(telemetry, r.fact)(spark, SF)
    facts.repartition(1).write.parquet(str(tmp_path / "in" / "a"))
    # one row far ahead moves the watermark past all others
    facts.filter(r.takes).limit(1).withColumn("time", F.lit(datetime(2030, 1, 1))).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    source = spark.readStream.schema(facts.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = r.stream(source).writeStream.format("memory").queryName(f"s_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(300)
    q.stop()
    exact = [c for c in r.states if c not in ("durations", "rss", "cpu", "sizes", "startups")]
    read = lambda df: df.select("bucket", *r.dims, *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) if dict(df.dtypes)[c] == "binary" else F.col(c) for c in exact])
    want = r.build(facts)
    want = r.merge(want, "day") if r.grain != "day" else want
    assert rows(read(spark.table(f"s_{name}"))) == rows(read(want)) and want.count() > 50


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """The facts as partitioned tables, and their rollups stored up to the twentieth of the month."""
    root = tmp_path_factory.mktemp("store")
    for signal in ("logs", "traces", "metrics"):
        getattr(telemetry, signal)(spark, SF).withColumn("date", F.to_date("time")).write.partitionBy("date").parquet(str(root / signal))
    s = Stored(spark, str(root / "rollups"), lambda signal: spark.read.parquet(str(root / signal)))
    s.refresh([date(2024, 1, d) for d in range(1, 21)], datetime(2024, 1, 20, 12, 40))
    return s


def test_stored_rollups_equal_those_of_all_facts(spark, store):
    for name, r in rollups().items():
        exact = [c for c in r.states if c not in ("durations", "rss", "cpu", "sizes", "startups")]
        for bucket in ("hour", "week") if r.grain == "hour" else ("week",):
            grain = "hour" if bucket == "hour" else "day"
            got, want = store.read(name, bucket), r.build(getattr(telemetry, r.fact)(spark, SF))
            want = r.merge(want, "day") if grain != r.grain else want
            read = lambda df: df.select("bucket", *r.dims, *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) if dict(df.dtypes)[c] == "binary" else F.col(c) for c in exact])  # noqa: E731, B023
            assert rows(read(got)) == rows(read(want)), (name, bucket)


def test_stored_reads_leave_whole_dates_alone(spark, store):
    """Without the raw facts of the dates that are stored whole the result is the same."""
    from pathlib import Path

    root = Path(store.path).parent

    def tail(signal):
        days = [str(p) for p in (root / signal).iterdir() if p.name >= "date=2024-01-20"]
        return spark.read.option("basePath", str(root / signal)).parquet(*days)

    short = Stored(spark, store.path, tail)
    for name in ("exit_codes", "session_activity"):
        for bucket in ("hour", "week") if name == "exit_codes" else ("week",):
            both = [rows(s.read(name, bucket).withColumnRenamed("installs", "i").drop("i")) for s in (short, store)]
            assert both[0] == both[1] and len(both[0]) > 100
    plan = store.read("exit_codes", "hour")._jdf.queryExecution().toString()
    assert "PartitionFilters: [NOT date" in plan or "PartitionFilters: [isnotnull(date" in plan


@pytest.mark.parametrize("name", ["q2_latency_exact", "q3_error_rate", "q4_command_frequency", "q6_exit_codes", "q8_active_installs", "q12_version_sizes", "q27_friction", "q33_measures", "q34_value_series", "q35_reach", "q36_ratio", "q36_counter_per_install", "q37_vendor_services"])
def test_queries_over_stored_rollups(spark, store, name):
    f = queries._QUERIES[name]
    assert rows(f(queries._Data(spark, SF, "t0", store))) == rows(f(queries._Data(spark, SF, "t0")))


def test_dirty_dates_are_refreshed_and_no_others(spark, tmp_path):
    r = rollups()["exit_codes"]
    cols = "time timestamp, tenant_id string, span_name string, cli_version string, os string, arch string, is_ci boolean, command_name string, exit_code int"
    made = lambda *days: spark.createDataFrame([(datetime(2024, 1, d, h), "t", "cli.command.x", None, None, None, None, "x", 0) for d, h in days], cols)
    path = str(tmp_path / "facts")
    put = lambda df, n: df.withColumn("date", F.to_date("time")).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
    s = Stored(spark, str(tmp_path / "r"), lambda _: spark.read.parquet(path), {"exit_codes": r})
    put(made((1, 5), (2, 6), (3, 7)), 0)
    s.note(made((1, 5), (2, 6), (3, 7)), "traces", 0)
    assert s.refresh_dirty(datetime(2024, 1, 3, 9, 30)) == [("exit_codes", date(2024, 1, d)) for d in (1, 2, 3)] and s.pending() == []
    before = {(x.grain, x.date): x.folder for x in s.catalogue.read().collect()}
    assert set(before) == {("hour", date(2024, 1, d)) for d in (1, 2, 3)} | {("day", date(2024, 1, d)) for d in (1, 2)}
    # a row that comes two days late is not seen until its date is refreshed
    put(made((1, 5)), 1)
    s.note(made((1, 5)), "traces", 1)
    count = lambda: {(x.bucket.day, x.bucket.hour): x.invocations for x in s.read("exit_codes", "hour").collect()}
    assert count() == {(1, 5): 1, (2, 6): 1, (3, 7): 1} and s.pending() == ["traces-1"]
    assert s.refresh_dirty(datetime(2024, 1, 3, 9, 50)) == [("exit_codes", date(2024, 1, 1))]
    after = {(x.grain, x.date): x.folder for x in s.catalogue.read().collect()}
    assert count() == {(1, 5): 2, (2, 6): 1, (3, 7): 1} and {k for k in before if before[k] != after[k]} == {("hour", date(2024, 1, 1)), ("day", date(2024, 1, 1))}
    # the same batch again: noted, refreshed, and nothing changes
    put(made((1, 5)), 1)
    s.note(made((1, 5)), "traces", 1)
    s.refresh_dirty(datetime(2024, 1, 3, 9, 55))
    assert count() == {(1, 5): 2, (2, 6): 1, (3, 7): 1}
    # a date that time has completed since is taken in without having been touched
    assert s.refresh_dirty(datetime(2024, 1, 4, 1)) == [("exit_codes", date(2024, 1, 3))]
    assert {x.bucket.day: x.invocations for x in s.read("exit_codes", "day").collect()} == {1: 2, 2: 1, 3: 1}
    s.prune()
    assert count() == {(1, 5): 2, (2, 6): 1, (3, 7): 1}


# --- the whole ingest stream

TIER = {"key": "cli.analytics.tier", "value": {"stringValue": "full"}}


def text(k, v):
    return {"key": k, "value": {"stringValue": v}}


def nano(at):
    return str(int((at - datetime(1970, 1, 1)).total_seconds()) * 10**9)


ANY = ingest.Attribute(max_length=4096)
RULES = ingest.Rules(
    ("anonymous", "basic", "full"),
    {k: ANY for k in ("cli.install_id", "cli.error.reason", "cli.error.message", "cli.counter.name", "cli.counter.label", "cli.activation.feature", "service.version")},
    {
        "cli.session.started": ingest.Event(("cli.install_id", "service.version")), "cli.error.raised": ingest.Event(("cli.install_id", "cli.error.reason", "cli.error.message")),
        "cli.counter": ingest.Event(("cli.counter.name", "cli.counter.label", "cli.dim.*")),
    },
    families={"cli.dim.": ingest.Attribute(pattern="[a-z]+")},
)


def log_file(path, records):
    path.mkdir(exist_ok=True)
    for n, (version, minute, event, more) in enumerate(records):
        log = {"timeUnixNano": nano(NOW + timedelta(minutes=minute)), "eventName": event, "attributes": [TIER, text("cli.install_id", "i1"), *more]}
        body = {"resourceLogs": [{"resource": {"attributes": [text("service.name", "s"), text("service.version", version)]}, "scopeLogs": [{"scope": {"name": "x"}, "logRecords": [log]}]}]}
        (path / f"{len(list(path.iterdir())):03d}-{n}.json").write_text(json.dumps(body))


def everything(job):
    """What the stream has written, in a form to compare."""
    out = {"states": rows(job.install_states()), "changes": rows(job.changes()), "found": rows(job.discoveries.read()), "folds": rows(job.folds()), "reasons": rows(job.reasons.known())}
    facts = job.facts("logs")
    return out | {"facts": rows(facts.select("time", "event_name", "cli_version", "error_reason", "install_id", "batch"))}


def test_log_stream_in_batches_and_again(spark, tmp_path):
    tenants = spark.createDataFrame([("t0", "full", "strip", 2)], "tenant_id string, tier_ceiling string, mode string, max_error_reasons int")
    job = Telemetry(spark, str(tmp_path / "t"), RULES, tenants)
    started, raised = "cli.session.started", "cli.error.raised"
    reason = lambda r: [text("cli.error.reason", r), text("cli.error.message", "boom 7")]
    source = lambda: otlp.read(spark, "logs", str(tmp_path / "in"), stream=True).withColumn("tenant_id", F.lit("t0"))
    day = timedelta(days=1)
    job_write, now = job.write, [NOW + timedelta(minutes=30)]
    job.write = lambda signal, records, n: job_write(signal, records, n, now[0])
    log_file(tmp_path / "in", [("1.0.0", 0, started, []), ("1.0.0", 1, raised, reason("dns")), ("1.0.0", 2, raised, reason("dns")), ("1.0.0", 3, raised, reason("tls"))])
    job.stream("logs", source(), str(tmp_path / "c")).awaitTermination(200)
    log_file(tmp_path / "in", [("1.1.0", 10, started, []), ("1.1.0", 11, raised, reason("disk")), ("1.1.0", 12, raised, reason("dns"))])
    job.stream("logs", source(), str(tmp_path / "c")).awaitTermination(200)
    first = everything(job)
    assert [x[:4] for x in first["changes"]] == [("t0", "i1", NOW + timedelta(minutes=10), "1.0.0")] and len(first["facts"]) == 7
    assert [x[1] for x in first["reasons"]] == ["dns", "tls"] and first["folds"] == [("t0", None, "reasons", NOW.date(), 1)]
    assert sorted(str(x[3]) for x in first["facts"]) == ["None", "None", "dns", "dns", "dns", "other", "tls"]
    # the second batch again, much later: judged by the time of its first try, all tables stay as they are
    records = otlp.read(spark, "logs", str(tmp_path / "in" / "00[4-6]*.json")).withColumn("tenant_id", F.lit("t0"))
    job_write("logs", records, 1, NOW + 40 * day)
    assert everything(job) == first
    job_write("logs", records, 2, NOW + 40 * day)  # as a batch of its own it comes too late
    assert len(everything(job)["facts"]) == 7
    dirty = job.rollups.refresh_dirty(NOW + day)
    assert {n for n, _ in dirty} >= {"session_activity"} and job.rollups.read("session_activity", "day").agg(F.sum("sessions")).first()[0] == 2


def test_metric_stream_caps_and_catalogue(spark, tmp_path):
    # the metric's definition: a counter with one dimension, deprecated at noon and a minute
    log = spark.createDataFrame(
        [("t0", "s", "found", "counter", ["check"], 0, NOW - timedelta(days=9), False), ("t0", "s", "found", "counter", ["check"], 0, NOW + timedelta(minutes=1), True), ("t0", "s", "timed", "value", [], 0, NOW - timedelta(days=9), False)],
        "tenant_id string, service_name string, name string, kind string, dims array<string>, min_rank int, changed_at timestamp, deprecated boolean",
    )
    tenants = spark.createDataFrame([("t0", "full", "strip", True, 1)], "tenant_id string, tier_ceiling string, mode string, strict_metrics boolean, max_counter_names int")
    job = Telemetry(spark, str(tmp_path / "t"), RULES, tenants, ingest.definition_versions(log), caps={"labels": 1, "dim_values": 2})

    def point(second, name, value=1, **dims):
        return {"timeUnixNano": nano(NOW + timedelta(seconds=second)), "asInt": str(value), "attributes": [TIER, text("cli.counter.name", name), *[text(f"cli.dim.{k}", v) for k, v in dims.items()]]}

    def sent(file, *points):
        metric = {"name": "cli.counter", "unit": "1", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": list(points)}}
        (tmp_path / file).write_text(json.dumps({"resourceMetrics": [{"resource": {"attributes": [text("service.name", "s")]}, "scopeMetrics": [{"scope": {"name": "x"}, "metrics": [metric]}]}]}))
        return otlp.read(spark, "metrics", str(tmp_path / file)).withColumn("tenant_id", F.lit("t0"))

    batch = sent("a.json", point(0, "found", check="jwt", extra="no"), point(1, "found", check="jwt"), point(2, "found", check="bola"), point(3, "found", check="cors"), point(90, "found", check="jwt"), point(4, "timed"), point(5, "never"))
    for _ in range(2):
        job.write("metrics", batch, 0, NOW + timedelta(minutes=3))
    facts = job.facts("metrics")
    # before the deprecation the old definition holds: one dimension stays; the third value and the second label fold
    assert rows(facts, "time", "name", "label") == [(NOW, "found", "check=jwt"), (NOW + timedelta(seconds=1), "found", "check=jwt"), (NOW + timedelta(seconds=2), "found", "other"), (NOW + timedelta(seconds=3), "found", "other")]
    reasons = {r.reason: r.n for r in spark.read.parquet(f"{job.root}/rejects/metrics-0").collect()}
    assert reasons == {None: 4, "undeclared": 2, "kind": 1}
    assert rows(job.folds(), "kind", "cap", "n") == [("counter", "dim_values", 1), ("counter", "labels", 2)]
    # a second stream's batch: the name's place is taken, so another name would fold; the label is known
    job.write("metrics", sent("b.json", point(30, "found", check="jwt")), 1, NOW + timedelta(minutes=3))
    assert job.names.known().count() == 1 and job.facts("metrics").count() == 5
    job.sweep(NOW + timedelta(days=2))
    assert [job.names.known().count(), job.labels.known().count(), job.dim_values.known().count()] == [0, 0, 0]


def test_retention_rewrites_only_partitions_of_shorter_tenants(spark, tmp_path):
    path = str(tmp_path / "logs")
    made = [(t, datetime(2024, 1, d, 5), k) for t in ("a", "b", "c", "d") for d in (1, 2, 20) for k in (1, 2)]
    df = spark.createDataFrame(made, "tenant_id string, time timestamp, k int")
    ingest.append(df, path, 3)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (tmp_path / "logs").rglob("*.parquet")}
    before = files()
    tenants = spark.createDataFrame([("a", 10), ("b", None), ("c", 400)], "tenant_id string, logs_days int")
    places = maintenance.drop_expired_of_tenants(spark, path, tenants, "logs_days", date(2024, 1, 21))
    assert sorted({p[:15] for p in places}) == ["date=2024-01-01", "date=2024-01-02"]
    left = rows(spark.read.parquet(path), "tenant_id", "time", "k")
    assert left == sorted((m for m in made if not (m[0] == "a" and m[1].day < 11)), key=repr)
    after = files()
    kept = {f for f in before if not any(f.startswith(p) for p in places)}
    assert kept and all(after.get(f) == before[f] for f in kept) and not [n for n in maintenance.Files(spark, path).names(path) if n.startswith("_out") or n.startswith("_new")]
    assert maintenance.drop_expired_of_tenants(spark, path, tenants, "logs_days", date(2024, 1, 21)) == []


def test_retain_drops_expired_dates_of_every_table(spark, tmp_path):
    tenants = spark.createDataFrame([("a", 5)], "tenant_id string, logs_days int")
    job = Telemetry(spark, str(tmp_path / "t"), None, tenants)
    cols = "time timestamp, tenant_id string, span_name string, cli_version string, os string, arch string, is_ci boolean, command_name string, exit_code int"
    made = lambda *days: spark.createDataFrame([(d, t, "cli.command.x", None, None, None, None, "x", 0) for d in days for t in "ab"], cols)
    day = lambda n: datetime(2024, 5, 31, 6) - timedelta(days=n)
    for signal in ("logs", "traces"):
        ingest.append(made(day(100), day(40), day(2)), f"{job.root}/facts/{signal}", 0)
    job.rollups.rules = {"exit_codes": rollups()["exit_codes"]}
    job.rollups.refresh([day(n).date() for n in (100, 40, 2)], datetime(2024, 5, 31))
    job.retain(date(2024, 5, 31))
    left = lambda signal: sorted({(r.tenant_id, (date(2024, 5, 31) - r.time.date()).days) for r in job.facts(signal).collect()})
    # spans go after 30 days, events after 90, those of the tenant that keeps them for five after five
    assert left("traces") == [("a", 2), ("b", 2)] and left("logs") == [("a", 2), ("b", 2), ("b", 40)]
    kept = {(r.grain, (date(2024, 5, 31) - r.date).days) for r in job.rollups.catalogue.read().collect()}
    assert kept == {("hour", 40), ("hour", 2), ("day", 100), ("day", 40), ("day", 2)}


def test_sessions_of_a_stream_close_at_the_gap(spark, tmp_path):
    from telemill.streaming.jobs import sessions

    at = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    runs = [("t", "i", at(0)), ("t", "i", at(20)), ("t", "i", at(55)), ("t", "j", at(5)), ("u", "i", at(5)), ("t", "far", at(60 * 24 * 9))]
    spark.createDataFrame(runs, "tenant_id string, install_id string, time timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema("tenant_id string, install_id string, time timestamp").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    q.stop()
    assert rows(spark.table("closed"), "tenant_id", "install_id", "first", "runs") == [("t", "i", at(0), 2), ("t", "i", at(55), 1), ("t", "j", at(5), 1), ("u", "i", at(5), 1)]
