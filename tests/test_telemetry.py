"""Hand-computed cases, and fixed vectors where forms must agree; a second tenant's rows must never show."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telemill.functions import labels, messages, sketches, versions
from telemill.operators import ingest, installs, maintenance, sessions, vendor, vocabulary
from telemill.operators.rollups import rollups
from telemill.plans.buckets import rebucket
from telemill.plans.scope import Filters, dimension
from telemill.sources import otlp

T0 = datetime(2024, 1, 1, 10)
ALL = Filters("t0", datetime(2024, 1, 1), datetime(2024, 2, 1), limit=1000)
LOG = "tenant_id string, install_id string, command_name string, time timestamp, id long, event_name string, exit_code int, cli_version string, os string, arch string, is_ci boolean, value double, install_method string"


def log(n, install, command, minute, exit_code=0, tenant="t0", version="1.0.0", value=1.0, event="cli.command.completed", os="linux", method=None):
    return (tenant, install, command, T0 + timedelta(minutes=minute), n, event, exit_code, version, os, "amd64", False, value, method)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_sessions(spark):
    # exactly half an hour is one session, a second more is two; equal commands in a row are one step
    runs = [("red", "pull", 0), ("red", "pull", 30), ("red", "push", 60.02), ("blue", "plan", 3), ("blue", "apply", 3.5), ("blue", "check", 200), ("blue", "check", 212), ("green", "scan", 1), ("green", "scan", 17)]
    df = frame(spark, [log(n, i, c, m) for n, (i, c, m) in enumerate(runs)] + [log(90, None, "scan", 5), log(91, "red", "scan", 5, tenant="leak"), log(92, "red", "scan", 5, event="cli.help.viewed")])
    got = {r.length: (r.sessions, r.median_seconds) for r in sessions.session_lengths(df, ALL).collect()}
    assert {k: v[0] for k, v in got.items()} == {"0": 1, "<1m": 1, "1-5m": 0, "5-15m": 1, "15-30m": 1, "30m+": 1, None: 5} and got[None][1] == 720
    steps = lambda *more: [(" ".join(r.commands), r.sessions) for r in sessions.session_sequences(df, ALL, *more).collect()]
    assert steps() == [("check", 1), ("plan apply", 1), ("pull", 1), ("push", 1), ("scan", 1)] and steps(2) == [("plan apply", 1)]


def test_retries(spark):
    runs = [("sync", "q1", "F0 F4 S7"), ("fetch", "q2", "F0 S10.5"), ("fetch", "q3", "S0 F3"), ("fetch", "q4", "F20 S30"), ("pack", "q4", "F0 F1 F2 F3"), ("sign", "q5", "S0 S1"), ("edge", "q6", "F0 F10 F20.1"), ("slow", "q7", "F0 F9 F18 F27")]
    rows = [log(n, i, c, float(x[1:]), int(x[0] == "F")) for n, (c, i, x) in enumerate((c, i, x) for c, i, xs in runs for x in xs.split())]
    df = frame(spark, rows + [log(90, "q1", "none", 0, None), log(91, None, "none", 0, 1), log(92, "q1", "none", 0, 1, tenant="leak")])
    got = {r.command_name: (r.failed, r.retried, r.sequences, r.recovered, r.repeated_installs) for r in sessions.retries(df, ALL).collect()}
    assert got == {"sync": (2, 2, 1, 1, 0), "fetch": (3, 1, 1, 1, 0), "pack": (4, 3, 1, 0, 1),
                   # ten minutes to the second are within the window; a streak of four is no burst where three failures take longer
                   "edge": (3, 1, 1, 0, 0), "slow": (4, 3, 1, 0, 0)}
    with pytest.raises(ValueError):
        sessions.retries(df, ALL, 7200)


def test_cold_and_warm(spark):
    # an install's first command is cold, and its first one after each change of version
    k1 = [("render", 0, "3.0.0"), ("render", 1, "3.0.0"), ("export", 5, "3.1.0"), ("export", 6, "3.1.0"), ("render", 7, "3.1.0"), ("render", 9, "3.0.0")]
    rows = [log(n, "k1", c, m, version=v, value=50.0 * (n + 1)) for n, (c, m, v) in enumerate(k1)] + [log(20, "k2", "render", 4, version="3.1.0"), log(21, "k2", "export", 8, version="3.1.0", value=None), log(22, "k1", "render", 2, tenant="leak")]
    df = frame(spark, rows)
    ask = lambda **f: {r.command_name: (r.cold_runs, r.warm_runs) for r in sessions.cold_warm_latency(df, installs.install_states(df), installs.version_changes(df), Filters("t0", ALL.start, ALL.end, **f), "day").collect()}
    assert ask() == {"render": (3, 2), "export": (1, 1)}
    assert ask(versions=("3.1.0",)) == {"render": (1, 1), "export": (1, 1)} and ask(commands=("export",)) == {"export": (1, 1)}


def test_install_states_and_changes(spark):
    start = "cli.session.started"
    rows = [log(0, "a", None, 0, version="2.0.0", event=start, method="brew"), log(1, "a", None, 1, version="1.9.0", event=start), log(2, "a", None, 2, version="1.9.1-rc.1", event=start), log(3, "a", None, 3, version="1.9.1", event=start),
            log(4, "b", None, 0, version="1.0.0", event=start), log(5, "b", "x", 1, 1, version="dev"), log(6, "b", "x", 2, 0, version="dev")]
    df = frame(spark, rows)
    assert [(r.direction, r.to_version) for r in installs.version_changes(df).orderBy("changed_at").collect()] == [("downgrade", "1.9.0"), ("upgrade", "1.9.1-rc.1"), ("upgrade", "1.9.1")]
    b = installs.install_states(df).filter("install_id = 'b'").first()
    assert (b.first_version, b.last_version, b.first_command_at, b.first_success_at) == ("1.0.0", "dev", T0 + timedelta(minutes=1), T0 + timedelta(minutes=2))


@pytest.mark.parametrize("a,b,want", [("1.9.0", "1.10.0", -1), ("1.0.0", "v1.0.0", 0), ("1.2", "1.2.0", 0), ("1.0.0-rc.1", "1.0.0", -1), ("1.0.0-rc.2", "1.0.0-rc.10", -1), ("1.0.0-alpha", "1.0.0-alpha.1", -1),
                                      ("1.0.0-1", "1.0.0-alpha", -1), ("1.0.0+build5", "1.0.0", 0), ("dev", "1.0.0", None), ("", "1.0.0", None), ("1.0.0-", "1.0.0", None), ("1.2.3.4", "1.0.0", None)])
def test_versions(spark, a, b, want):
    assert spark.range(1).select(versions.compare(F.lit(a), F.lit(b))).first()[0] == want


@pytest.mark.parametrize("counts,least,most,q,want", [({}, None, None, 0.9, None), ({3: 40}, None, None, 0.25, 20), ({4: 10}, None, None, 0.9, 95), ({1: 20, 6: 20}, None, None, 0.75, 750), ({3: 40}, 12.0, 25.0, 0.5, 25),
                                                      ({3: 40}, 33.0, 45.0, 0.1, 33), ({11: 4}, 350000.0, 500000.0, 0.5, 400000),
                                                      ({0: 10}, 0.5, None, 0.5, 0.75), ({0: 10}, None, None, 0.2, 0.2), ({2: 8, 3: 8}, None, None, 0.5, 10), ({11: 4}, None, None, 0.5, 300000)])
def test_histogram_quantile(spark, counts, least, most, q, want):
    df = spark.range(1).select(*[F.lit(counts.get(i, 0)).alias(f"b{i}") for i in range(12)], F.lit(least).cast("double").alias("least"), F.lit(most).cast("double").alias("most"))
    got = df.select(sketches.histogram_quantile(q, sketches.MEASURE_BOUNDS, F.col("least"), F.col("most"))).first()[0]
    assert got == want if want is None else abs(got - want) < 1e-6


# Messages and the form that their fingerprint must be made of.
MESSAGES = {
    "open /home/alice/.config/tool/config.yaml: permission denied": "open <path>: permission denied", r"open C:\Users\Bob\AppData\Local\Temp\x.json: access denied": "open <path>: access denied",
    r"cannot reach \\fileserver\share\x": "cannot reach <path>", "invalid read/write mode": "invalid read/write mode", 'unknown flag "--frobnicate"': "unknown flag <str>",
    "project 3f8c2a1e-9b4d-4c6e-8f0a-1b2c3d4e5f60 not found": "project <uuid> not found", "commit a1b2c3d4e5f6 missing": "commit <hex> missing", "deadbeefcafe is a word here": "deadbeefcafe is a word here",
    "retry 3 of 5 failed after 30s": "retry <n> of <n> failed after <n>", "dial tcp 10.0.0.12:8443: connection refused": "dial tcp <n>: connection refused", "utf8 decode error in ipv6 parser": "utf8 decode error in ipv6 parser",
    "GET https://api.example.com/v1/users/42?x=1 returned 503": "GET <url> returned <n>",
}


def test_messages(spark):
    df = spark.createDataFrame(list(MESSAGES.items()), "m string, want string")
    assert [(r.got, r.want) for r in df.select(messages.normalised(F.col("m")).alias("got"), "want").collect() if r.got != r.want] == []
    assert all(messages._plain(m, messages._python_rules()) == w for m, w in MESSAGES.items())


def test_frames():
    python = 'Traceback (most recent call last):\n  File "/a/main.py", line 3, in main\n    run()\n  File "/b/run.py", line 9, in run\n    boom()'
    assert messages.frames(python) == ["run run.py", "main main.py"]
    go = "goroutine 1 [running]:\nmain.(*T).Do(0xc000, 0x1)\n\t/src/app/do.go:41 +0x1d\nmain.main()\n\t/src/app/main.go:9 +0x20"
    assert messages.frames(go) == ["main.(*T).Do do.go", "main.main main.go"]
    assert messages.frames("Error: x\n    at run (/home/u/app/index.js:10:5)\n    at main (/home/u/app/cli.js:2:1)") == ["run index.js", "main cli.js"]
    assert messages.frames("no frame here") == []


def test_labels(spark):
    df = spark.createDataFrame([({"zone": "eu", "plan": "pro"},)], "d map<string,string>").select(labels.label_of(F.col("d")).alias("l"))
    assert df.first().l == "plan=pro;zone=eu" and df.select(labels.dims_of(F.col("l"))).first()[0] == {"plan": "pro", "zone": "eu"}
    get = lambda label, key: spark.range(1).select(dimension(F.lit(label), key)).first()[0]
    # a key that is only the end of another one's name is not found; a plain label is its own dimension; other is other for all
    assert [get("plan=pro;timezone=eu", "zone"), get("plan=pro", "plan"), get("nightly", "label"), get("nightly", "plan"), get("other", "plan"), get("", "label"), get(None, "plan")] == [None, "pro", "nightly", None, "other", None, None]
    with pytest.raises(ValueError):
        get("plan=pro", "pl;an")


def test_vocabulary(spark):
    rows = lambda **n: spark.createDataFrame([("t", "n", "zone", v) for v, k in n.items() for _ in range(k)], "tenant_id string, name string, key string, value string")
    batch, keys = rows(us=4, eu=4, ap=2, other=7), ["tenant_id", "name", "key"]
    known = vocabulary.admitted(batch, batch.limit(0), keys, "value", 2)
    assert sorted(r.value for r in known.collect()) == ["eu", "us"] and [r.value for r in vocabulary.admitted(batch, batch.limit(0), keys, "value", 1).collect()] == ["eu"]
    out = vocabulary.capped(batch, known, keys, "value")
    assert (out.filter("__folded").count(), out.filter("value = 'other'").count()) == (2, 9)
    later = rows(af=9, ap=1, us=3)
    assert [sorted(r.value for r in vocabulary.admitted(later, known, keys, "value", cap).collect()) for cap in (2, 3, 4)] == [["eu", "us"], ["af", "eu", "us"], ["af", "ap", "eu", "us"]]


def test_two_level_vocabulary(spark):
    rows = spark.createDataFrame([("t", n, l) for n, l, k in [("a", "x=1", 3), ("a", "x=2", 2), ("b", "y=1", 2), ("c", "z=1", 1), ("other", "q=1", 1)] for _ in range(k)], "tenant_id string, name string, label string")
    none = rows.limit(0)
    out, names, _ = vocabulary.capped_metrics(rows, none.select("tenant_id", "name"), none, 2, 1)
    got = sorted((r.name, str(r.label), r["count"]) for r in out.groupBy("name", "label").count().collect())
    assert got == [("a", "other", 2), ("a", "x=1", 3), ("b", "y=1", 2), ("other", "None", 2)] and names.count() == 2
    dims, _ = vocabulary.capped_dimensions(rows, spark.createDataFrame([], "tenant_id string, name string, key string, value string"), 1)
    assert dims.filter("dim_folded").count() == 2


def test_live_rollup_equals_whole(spark):
    from telemill.sources import telemetry

    r, facts = rollups()["command_stats"], telemetry.traces(spark, "/root/testdata/sf0.001")
    at = datetime(2024, 1, 15, 7, 30)
    stored = r.build(facts).filter(F.col("bucket") < F.lit(at))
    assert r.live(stored, facts, at).drop("durations").exceptAll(r.build(facts).drop("durations")).count() == 0
    assert r.live(stored, facts, at).agg(F.sum("invocations")).first()[0] == facts.count()


def test_refresh_overwrites_only_its_dates(spark, tmp_path):
    from telemill.sources import telemetry

    r, facts, path = rollups()["exit_codes"], telemetry.traces(spark, "/root/testdata/sf0.001"), str(tmp_path / "r")
    r.refresh(facts, path, date(2024, 1, 1), date(2024, 2, 1))
    before = spark.read.parquet(path).count()
    r.refresh(facts, path, date(2024, 1, 5), date(2024, 1, 8))
    assert spark.read.parquet(path).count() == before
    assert len(maintenance.drop_expired(spark, path, date(2024, 1, 11), 5)) == 5


def test_filters_guard():
    with pytest.raises(ValueError):
        Filters("t", datetime(2024, 1, 1), datetime(2025, 1, 1))
    with pytest.raises(ValueError):
        Filters("", ALL.start, ALL.end)
    with pytest.raises(ValueError):
        rebucket("hour", None, "day")
    assert (Filters("t", ALL.start, ALL.end, limit=5000).rows, Filters("t", ALL.start, ALL.end).rows) == (1000, 100)


RULES = ingest.Rules(
    tiers=("anonymous", "basic", "full", "optin_plus"),
    attributes={"cli.command.name": ingest.Attribute(max_length=16), "cli.exit_code": ingest.Attribute("int"), "cli.install_id": ingest.Attribute(tier="basic"), "cli.shell": ingest.Attribute(values=("bash", "zsh"))},
    events={"cli.command.completed": ingest.Event(("cli.command.name", "cli.exit_code", "cli.install_id", "cli.shell"), required=("cli.command.name",)), "cli.error.raised": ingest.Event(("cli.command.name",), drop_body=True)},
)


def test_log_ingest(spark, tmp_path):
    now = datetime(2024, 1, 1, 12)
    at = lambda h: str(int((now - timedelta(hours=h) - datetime(1970, 1, 1)).total_seconds()) * 10**9)
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    record = lambda h, name, *attrs: {"timeUnixNano": at(h), "eventName": name, "body": {"stringValue": "b"}, "attributes": list(attrs)}
    done, tier = "cli.command.completed", lambda t: text("cli.analytics.tier", t)
    logs = [
        record(1, done, text("cli.command.name", "build"), {"key": "cli.exit_code", "value": {"intValue": "99999999999"}}, text("cli.install_id", "i1"), text("cli.shell", "tcsh"), text("x", "y"), tier("basic")),
        record(1, done, text("cli.command.name", "test"), text("cli.install_id", "i1"), tier("anonymous")), record(1, done, tier("basic")), record(1, "nope", tier("basic")), record(30, done, tier("basic")),
        record(1, done, text("cli.command.name", "x")), record(1, done, text("cli.command.name", "full"), tier("full")),
    ]
    (tmp_path / "in.json").write_text(json.dumps({"resourceLogs": [{"resource": {"attributes": [text("service.name", "svc")]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": logs}]}]}))
    records = otlp.read(spark, "logs", str(tmp_path / "in.json")).withColumn("tenant_id", F.lit("t0"))
    tenants = spark.createDataFrame([("t0", "basic", "strip")], "tenant_id string, tier_ceiling string, mode string")
    rows = ingest.log_rows(records, RULES, tenants, F.lit(now)).collect()
    assert sorted(str(r.reason) for r in rows) == ["None", "None", "None", "event", "required", "tier", "time"]
    by = {r.command_name: r for r in rows if r.reason is None}
    assert (by["build"].exit_code, by["build"].install_id, by["build"].service_name, by["build"].body) == (2**31 - 1, "i1", "svc", None)
    assert "cli.shell" not in by["build"].attributes and by["test"].install_id is None and by["full"].consent_tier == "basic"


def test_definitions(spark):
    cols = "tenant_id string, service_name string, name string, kind string, spec string"
    stored = spark.createDataFrame([("t", "s", "a", "counter", "1", None), ("t", "s", "b", "value", "1", None), ("t", "s", "c", "value", "1", None)], cols + ", deprecated_at timestamp")
    new = spark.createDataFrame([("t", "s", "a", "counter", "1"), ("t", "s", "b", "value", "2"), ("t", "s", "d", "ratio", "1")], cols)
    assert {r.name: r.change for r in vendor.sync_definitions(stored, new).collect()} == {"a": "unchanged", "b": "updated", "c": "deprecated", "d": "created"}


def exported(at):
    """One export file for each signal, of a tool's runs, an error with its trace, and vendor metrics."""
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    tier, service = text("cli.analytics.tier", "full"), [text("service.name", "svc"), text("service.version", "1.2.0"), text("os.type", "linux")]
    stack = 'Traceback (most recent call last):\n  File "/a/main.py", line 3, in main\n    run()\n  File "/b/run.py", line 9, in run\n    boom()'
    logs = [
        {"timeUnixNano": at(1), "eventName": "cli.error.raised", "attributes": [tier, text("cli.error.message", 'open "/x/1": denied'), text("cli.error.stacktrace", stack), text("cli.error.type", "io")]},
        {"timeUnixNano": at(2), "eventName": "cli.feature.activated", "attributes": [tier, text("cli.activation.feature", "export"), text("cli.install_id", "i1"), {"key": "cli.config.customized_count", "value": {"intValue": "4"}}]},
    ]
    spans = [{"traceId": "t1", "spanId": "s1", "name": "cli.command.build", "startTimeUnixNano": at(3), "endTimeUnixNano": str(int(at(3)) + 1_500_000), "attributes": [tier, text("cli.command.name", "build")]}]
    dims = lambda **d: [text(f"cli.dim.{k}", v) for k, v in d.items()]
    counts = [0, 30, 20] + [0] * 9
    points = [
        ("cli.counter", {"sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [
            {"timeUnixNano": at(1), "asInt": "5", "attributes": [tier, text("cli.counter.name", "found"), text("cli.counter.label", "plain"), *dims(check="jwt")]},
            {"timeUnixNano": at(1), "asInt": "2", "attributes": [tier, text("cli.counter.name", "found"), text("cli.counter.label", "x"), *dims(label="y")]},
            {"timeUnixNano": at(1), "asInt": "7", "attributes": [tier, text("cli.counter.name", "found"), *dims(**{"BAD KEY": "y"})]}]}}),
        ("cli.measure", {"histogram": {"aggregationTemporality": 1, "dataPoints": [
            {"timeUnixNano": at(1), "count": "50", "sum": 900.0, "min": 3.0, "max": 40.0, "bucketCounts": [str(c) for c in counts], "explicitBounds": list(sketches.MEASURE_BOUNDS), "attributes": [tier, text("cli.measure.name", "scan")]}]}}),
    ]
    resource = {"attributes": service}
    return {
        "logs": {"resourceLogs": [{"resource": resource, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": logs}]}]},
        "traces": {"resourceSpans": [{"resource": resource, "scopeSpans": [{"scope": {"name": "s"}, "spans": spans}]}]},
        "metrics": {"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"scope": {"name": "s"}, "metrics": [{"name": n, "unit": "1", **kind} for n, kind in points]}]}]},
    }


def test_exported_records_reach_the_queries(spark, tmp_path):
    from telemill.operators import commands, errors, sessions
    from telemill.plans.scope import json_number

    now = datetime(2024, 1, 1, 12)
    at = lambda h: str(int((now - timedelta(hours=h) - datetime(1970, 1, 1)).total_seconds()) * 10**9)
    any_text = ingest.Attribute(max_length=4096)
    names = "cli.command.name cli.error.message cli.error.stacktrace cli.error.type cli.activation.feature cli.install_id cli.counter.name cli.counter.label cli.measure.name".split()
    rules = ingest.Rules(
        ("anonymous", "basic", "full"), {n: any_text for n in names} | {"cli.config.customized_count": ingest.Attribute("int")},
        {
            "cli.error.raised": ingest.Event(("cli.error.message", "cli.error.stacktrace", "cli.error.type")), "cli.feature.activated": ingest.Event(("cli.activation.feature", "cli.install_id", "cli.config.customized_count")),
            "cli.command.*": ingest.Event(("cli.command.name",)), "cli.counter": ingest.Event(("cli.counter.name", "cli.counter.label", "cli.dim.*")), "cli.measure": ingest.Event(("cli.measure.name",), bounds=tuple(sketches.MEASURE_BOUNDS)),
        },
        families={"cli.dim.": ingest.Attribute(pattern="[a-z]+")},
    )
    tenants = spark.createDataFrame([("t0", "full", "strip")], "tenant_id string, tier_ceiling string, mode string")
    made = {}
    for signal, body in exported(at).items():
        (tmp_path / f"{signal}.json").write_text(json.dumps(body))
        records = otlp.read(spark, signal, str(tmp_path / f"{signal}.json")).withColumn("tenant_id", F.lit("t0"))
        build = {"logs": ingest.log_rows, "traces": ingest.span_rows, "metrics": ingest.metric_rows}[signal]
        rows = build(records, rules, tenants, F.lit(now))
        made[signal] = rows
        ingest.append(ingest.accepted(rows), str(tmp_path / signal), 7)
        ingest.append(ingest.accepted(rows), str(tmp_path / signal), 7)
    facts = {s: spark.read.parquet(str(tmp_path / s)) for s in made}
    assert {s: f.count() for s, f in facts.items()} == {"logs": 2, "traces": 1, "metrics": 2}
    assert sorted(str(r.reason) for r in made["metrics"].collect()) == ["None", "None", "dimensions", "dimensions"]
    assert len(maintenance.expired_dates(spark, str(tmp_path / "logs"), date(2024, 3, 1), 30)) == 1
    f = Filters("t0", datetime(2024, 1, 1), datetime(2024, 1, 2))
    rolled = {k: r.merge(r.build(facts[r.fact]), "day") for k, r in rollups().items() if k in ("counters", "measures", "command_stats")}
    assert [tuple(r) for r in vendor.counters(rolled["counters"], f).collect()] == [("found", 5.0, 1, 1)]
    assert vendor.counter_groups(rolled["counters"], f, "found", "day", ("check",)).first().d0 == "jwt" and rolled["counters"].first().label == "check=jwt;label=plain"
    m = vendor.measures(rolled["measures"], f).first()
    assert (m.name, m.n, m.total, m.least, m.most) == ("scan", 50, 900.0, 3.0, 40.0)
    e = facts["logs"].filter("event_name = 'cli.error.raised'").first()
    assert (e.error_source, e.top_frame, e.error_type, len(e.error_fingerprint)) == ("stack", "run run.py", "io", 16)
    assert facts["logs"].filter(json_number("cli.config.customized_count") == 4).count() == 1 and facts["logs"].filter(F.col("feature") == "export").first().install_id == "i1"
    assert commands.list_traces(facts["traces"], f).count() == 1 and facts["traces"].first().duration_ms == 1.5
    assert errors.error_types(facts["logs"], f, "day").first().error_type == "io"
    assert sessions.environment_values().keys() >= {"shell", "auth", "config"}


def test_long_quoted_messages(spark):
    text = 'say "' + "a\\\\" * 100_000 + '" and \'' + "b" * 100_000 + "'"
    assert spark.createDataFrame([(text,)], "m string").select(messages.normalised(F.col("m"))).first()[0] == "say <str> and <str>" == messages._plain(text, messages._python_rules())


def test_refresh_clears_dates_without_rows(spark, tmp_path):
    r = rollups()["exit_codes"]
    cols = "time timestamp, tenant_id string, span_name string, cli_version string, os string, arch string, is_ci boolean, command_name string, exit_code int"
    facts = spark.createDataFrame([(datetime(2024, 1, d, 5), "t", "cli.command.x", None, None, None, None, "x", 0) for d in (1, 2)], cols)
    r.refresh(facts, str(tmp_path / "r"), date(2024, 1, 1), date(2024, 1, 3))
    r.refresh(facts.filter(F.col("time") < "2024-01-02"), str(tmp_path / "r"), date(2024, 1, 1), date(2024, 1, 3))
    assert [str(x.date) for x in spark.read.parquet(str(tmp_path / "r")).collect()] == ["2024-01-01"]


def test_typed_json(spark):
    from telemill.plans.scope import json_number

    df = spark.createDataFrame([('{"a.b":3}',), ('{"a.b":"3"}',), ('{"a.b":2.5}',), ('{"a.b":null}',), ('{"a.b":true}',), ("not json",), (None,)], "attributes string")
    assert [r[0] for r in df.select(json_number("a.b")).collect()] == [3.0, None, 2.5, None, None, None, None]


def test_attributes_out_of_bounds_are_left_out(spark):
    def pair(key, **value):
        return f'{{"key": "{key}", "value": {json.dumps(value)}}}'

    given = [pair("a", stringValue="x"), pair("k" * 128, stringValue="long key"), pair("k" * 129, stringValue="y"), pair("v", stringValue="v" * 4096), pair("w", stringValue="w" * 4097), pair("twice", intValue="1"), pair("twice", stringValue="last"),
             pair("map", kvlistValue="{}"), pair("bytes", bytesValue="AA"), pair("mixed", arrayValue={"values": [{"stringValue": "p"}, {}]}), pair("list", arrayValue={"values": [{"stringValue": "p"}, {"stringValue": "q"}]}),
             pair("b", boolValue=True), pair("d", doubleValue=2.5), pair("bad", intValue="12x")]
    df = spark.createDataFrame([("[" + ",".join(given) + "]",), (None,)], "j string").select(F.from_json("j", otlp.KEYS).alias("p"))
    got = [r[0] for r in df.select(otlp.attributes(F.col("p"))).collect()]
    assert sorted(got[0]) == sorted(["a", "k" * 128, "v", "twice", "list", "b", "d", "bad"]) and got[1] == {}
    assert (got[0]["twice"].s, got[0]["twice"].i, got[0]["list"].a, got[0]["d"].d, got[0]["b"].b, got[0]["bad"].i) == ("last", None, ["p", "q"], 2.5, True, None)
    many = lambda n: spark.createDataFrame([("[" + ",".join(pair(f"a{k}", stringValue="x") for k in range(n)) + "]",)], "j string").select(otlp.too_many(F.from_json("j", otlp.KEYS))).first()[0]
    assert (many(64), many(65)) == (False, True)


@pytest.mark.parametrize("name, kept, dropped", [("peak_rss_bytes", (1, 2**40), (0, -5, 2**40 + 1)), ("binary_size_bytes", (1, 4 * 2**30), (0, 4 * 2**30 + 1)), ("startup_ms", (0, 3_600_000), (-1, 3_600_001)), ("cpu_time_ms", (1,), (0, 2**52))])
def test_plausible_numbers(spark, name, kept, dropped):
    df = spark.createDataFrame([(v,) for v in (*kept, *dropped)], "v long")
    assert [r[0] for r in df.select(ingest.plausible(F.col("v"), name)).collect()] == [*kept, *[None] * len(dropped)]


def test_metric_points_that_are_refused(spark, tmp_path):
    now = datetime(2024, 1, 1, 12)
    at = str(int((now - datetime(1970, 1, 1)).total_seconds()) * 10**9)
    tier = {"key": "cli.analytics.tier", "value": {"stringValue": "full"}}
    rules = ingest.Rules(("anonymous", "basic", "full"), {}, {"sized": ingest.Event((), unit="By"), "timed": ingest.Event((), bounds=(1, 10)), "free": ingest.Event(()), "must": ingest.Event((), tier="full")})
    point = lambda **more: {"timeUnixNano": at, "attributes": [tier], **more}
    total = lambda name, unit="By", temporality=1, monotonic=True, **more: {"name": name, "unit": unit, "sum": {"aggregationTemporality": temporality, "isMonotonic": monotonic, "dataPoints": [point(**more)]}}
    spread = lambda counts, n, bounds=(1, 10), temporality=1, **more: {"name": "timed", "unit": "ms", "histogram": {"aggregationTemporality": temporality, "dataPoints": [point(count=str(n), bucketCounts=[str(c) for c in counts], explicitBounds=list(bounds), **({"sum": 5.0} | more))]}}
    sent = [
        (total("sized", asInt="5"), None), (total("sized", unit="ms", asInt="5"), "unit"), (total("sized", temporality=2, asInt="5"), "temporality"), (total("sized", asDouble=-1.0), "value"), (total("sized"), "value"), (total("sized", monotonic=False, asDouble=-1.0), None),
        (spread([1, 2, 0], 3), None), (spread([1, 2, 0], 4), "histogram"), (spread([1, 2], 3), "histogram"), (spread([1, 2, 0], 3, bounds=(1, 20)), "bounds"), (spread([1, 2, 0], 3, temporality=2), "temporality"), (spread([1, 2, 0], 3, min=-2.0), "histogram"), (spread([1, 2, 0], 3, sum=-1.0), "histogram"),
        ({"name": "free", "gauge": {"dataPoints": [point(asDouble=-3.0)]}}, None), ({"name": "unknown", "gauge": {"dataPoints": [point(asDouble=1.0)]}}, "event"),
    ]
    for n, (metric, _) in enumerate(sent):
        metric["description"] = str(n)
    resource = lambda n: {"attributes": [{"key": "service.name", "value": {"stringValue": str(n)}}]}
    (tmp_path / "m.json").write_text(json.dumps({"resourceMetrics": [{"resource": resource(n), "scopeMetrics": [{"scope": {"name": "s"}, "metrics": [m]}]} for n, (m, _) in enumerate(sent)]}))
    records = otlp.read(spark, "metrics", str(tmp_path / "m.json")).withColumn("tenant_id", F.lit("t0"))
    rows = ingest.metric_rows(records, rules, spark.createDataFrame([("t0", "full", "reject")], "tenant_id string, tier_ceiling string, mode string"), F.lit(now)).persist()
    assert {int(r.service_name): r.reason for r in rows.collect()} == {n: why for n, (_, why) in enumerate(sent)}
    counted = {r.reason: (r.n, r.sample) for r in ingest.reject_counts(rows).collect()}
    assert {k: v[0] for k, v in counted.items()} == {None: 4, "unit": 1, "temporality": 2, "value": 2, "histogram": 4, "bounds": 1, "event": 1} and counted["unit"][1] == "sized" and counted["event"][1] is None
    # mode reject: a tier over the ceiling is refused, not lowered
    low = spark.createDataFrame([("t0", "basic", "reject")], "tenant_id string, tier_ceiling string, mode string")
    assert {r.reason for r in ingest.metric_rows(records, rules, low, F.lit(now)).collect()} == {"consent", "event"}


def test_filters_on_attributes_and_exit_codes(spark):
    from telemill.plans.scope import all_of, facts

    rows = [(n, "t0", T0, code, ci, attributes) for n, (code, ci, attributes) in enumerate([(0, True, '{"cli.shell":"zsh","x.y":"1"}'), (1, False, '{"cli.shell":"bash"}'), (130, None, '{"cli.shell":"fish","x.y":null}'), (None, True, "{}"), (1, True, None)])]
    df = spark.createDataFrame(rows, "id int, tenant_id string, time timestamp, exit_code int, is_ci boolean, attributes string")

    def ids(**more):
        f = Filters("t0", ALL.start, ALL.end, **more)
        return sorted(r.id for r in facts(df, f, "exit_code", "is_ci").filter(all_of(f.attributes())).collect())

    assert [ids(exit_code=1), ids(exit_code=0), ids(is_ci=True), ids(is_ci=False), ids(exit_code=1, is_ci=True)] == [[1, 4], [0], [0, 3, 4], [1], [4]]
    assert [ids(equals={"cli.shell": "zsh"}), ids(among={"cli.shell": ("zsh", "fish")}), ids(exists=("cli.shell",)), ids(exists=("x.y",)), ids(equals={"cli.shell": "zsh", "x.y": "2"})] == [[0], [0, 2], [0, 1, 2], [0], []]
    assert [ids(contains={"cli.shell": "s"}), ids(matches={"cli.shell": "^.{4}$"})] == [[0, 1, 2], [1, 2]]


def test_quantile_sketches_keep_their_rank_error(spark):
    """Fifty merged sketches of 2,000 values each, of a skewed distribution: ranks within 2 %."""
    df = spark.range(100_000).select((F.col("id") % 50).alias("part"), F.pow(F.lit(1.0001), F.pmod(F.hash("id"), F.lit(100_000))).alias("v"))
    one = df.groupBy("part").agg(sketches.quantile_sketch(F.col("v")).alias("s")).agg(sketches.merge_quantiles(F.col("s")).alias("s"))
    qs = (0.01, 0.5, 0.9, 0.99)
    read = one.select(*[sketches.read_quantile(F.col("s"), F.lit(1), q).alias(f"q{k}") for k, q in enumerate(qs)]).first()
    rank = df.agg(*[F.avg((F.col("v") <= x).cast("int")) for x in read]).first()
    assert all(abs(r - q) < 0.02 for r, q in zip(rank, qs))
