"""From export records to fact rows: skew, consent, allowlist, promotion, plausibility, shapes, catalogue.

Every step is a projection or a filter in the scan's own stage.  The rules come as a Rules value, which is
a few hundred entries by nature, and become literals of the plan.  A record that fails keeps a reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import dims_of, label_of
from ..functions.messages import fingerprint, frames_of
from ..functions.sketches import VALUE_BOUNDS
from ..sources.otlp import attributes, merged, nanos, too_many

PAST, FUTURE = "interval 24 hours", "interval 5 minutes"
INT_MAX = 2**31 - 1
# What a measured number can plausibly be.
PLAUSIBLE = {
    "peak_rss_bytes": (1, 2**40), "cpu_time_ms": (1, 31 * 24 * 3600 * 1000 * 1024), "binary_size_bytes": (1, 4 * 2**30), "startup_ms": (0, 3_600_000),
}
PROMOTED = {"cli_version": "service.version", "os": "os.type", "arch": "host.arch", "command_name": "cli.command.name", "install_id": "cli.install_id", "service_name": "service.name"}
TIER_KEY, DIM_PREFIX = "cli.analytics.tier", "cli.dim."
#: Vendor instruments: where their points carry name and label.
INSTRUMENTS = ("cli.counter", "cli.measure", "cli.value")
MOST_DIMS = 3


@dataclass(frozen=True)
class Attribute:
    """What an attribute may hold, and from which tier on."""

    type: str = "string"
    tier: str = "anonymous"
    max_length: int | None = None
    max_items: int | None = None
    values: tuple[str, ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class Event:
    """An event, span (its name may end in *) or metric: what it may and must carry."""

    allowed: tuple[str, ...]
    required: tuple[str, ...] = ()
    tier: str = "anonymous"
    drop_body: bool = False
    unit: str | None = None
    bounds: tuple[int, ...] = ()


@dataclass(frozen=True)
class Rules:
    tiers: tuple[str, ...]
    attributes: dict[str, Attribute]
    events: dict[str, Event]
    #: prefix -> its attribute, whose pattern is of the rest of the key; an event allows the family as prefix + "*"
    families: dict[str, Attribute] = field(default_factory=dict)
    standard: tuple[str, ...] = ("service.name", "service.version", "os.type", "host.arch")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def event_key(name: Column, rules: Rules) -> Column:
    """The rule that a name falls under: its own, else a span pattern ending in *; null if none."""
    stars = sorted((e for e in rules.events if e.endswith("*")), key=len, reverse=True)
    exact = F.when(name.isin([e for e in rules.events if not e.endswith("*")]), name)
    return reduce(lambda c, e: F.coalesce(c, F.when(name.startswith(e[:-1]), F.lit(e))), stars, exact)


def tier_rank(tier: Column, rules: Rules) -> Column:
    return reduce(lambda c, t: c.when(tier == t[1], t[0]), enumerate(rules.tiers), F.when(F.lit(False), 0)).otherwise(None)


def valid(value: Column, rule: Attribute) -> Column:
    """Is a typed value (one field set) of the rule's type and inside its bounds."""
    if rule.type == "string":
        checks = [value["s"].isNotNull()]
        if rule.max_length is not None:
            checks.append(F.length(value["s"]) <= rule.max_length)
        if rule.values:
            checks.append(value["s"].isin(list(rule.values)))
        if rule.pattern:
            checks.append(value["s"].rlike(rule.pattern))
    elif rule.type == "string_array":
        checks = [value["a"].isNotNull()]
        if rule.max_items is not None:
            checks.append(F.size(value["a"]) <= rule.max_items)
        if rule.max_length is not None:
            checks.append(F.forall(value["a"], lambda x: F.length(x) <= rule.max_length))
    else:
        checks = [value[{"int": "i", "bool": "b", "double": "d"}[rule.type]].isNotNull()]
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def _kept(key: Column, value: Column, rules: Rules, event: Column, rank: Column) -> Column:
    """May an attribute stay: standard ones always, others, families too, by event, tier and validity."""
    listed = lambda name: F.coalesce(reduce(lambda c, e: c.when(event == e, F.array_contains(F.array(*map(F.lit, rules.events[e].allowed)).cast("array<string>"), name)), rules.events, F.when(F.lit(False), False)), F.lit(False))
    known = [(key == k) & (rank >= rules.tiers.index(r.tier)) & valid(value, r) for k, r in rules.attributes.items()]
    family = [
        key.startswith(p) & ~key.isin(list(rules.attributes)) & F.substring(key, len(p) + 1, 1 << 20).rlike(f"^(?:{r.pattern or '.+'})$")
        & listed(F.lit(f"{p}*")) & (rank >= rules.tiers.index(r.tier)) & valid(value, replace(r, pattern=None))
        for p, r in rules.families.items()
    ]
    return key.isin(list(rules.standard)) | (listed(key) & _any(known)) | _any(family)


def evaluated(records: DataFrame, rules: Rules, name: Column, tenants: DataFrame, now: Column) -> DataFrame:
    """Records with attrs stripped to what rules and consent allow, tier, rule, and reason (null if accepted).

    records: tenant_id, time, resource, record_attrs (key lists).  tenants: tenant_id, tier_ceiling, mode, joined
    as the optimizer chooses; a tenant without configuration is rejected.  The record's tier wins over the
    resource's.  A tier over the ceiling is rejected (mode reject) or lowered to it (mode strip).
    """
    rows = records.withColumn("rule", event_key(name, rules)).withColumn("res", attributes(F.col("resource"))).withColumn("rec", attributes(F.col("record_attrs")))
    rows = rows.join(tenants.select("tenant_id", "tier_ceiling", "mode"), "tenant_id", "left")
    said = tier_rank(F.coalesce(F.col("rec")[TIER_KEY]["s"], F.col("res")[TIER_KEY]["s"]), rules)
    ceiling = tier_rank(F.col("tier_ceiling"), rules)
    rows = rows.withColumn("said", said).withColumn("ceiling", ceiling).withColumn("rank", F.least("said", "ceiling"))
    # what the record itself carried, and how many dimensions were sent, before anything is stripped
    rows = rows.withColumn("own_keys", F.map_keys("rec")).withColumn("dims_sent", F.size(F.filter(F.map_keys(merged(F.col("res"), F.col("rec"))), lambda k: k.startswith(DIM_PREFIX))))
    rows = rows.withColumn("attrs", F.map_filter(merged(F.col("res"), F.col("rec")), lambda k, v: _kept(k, v, rules, F.col("rule"), F.col("rank"))))
    need = [(F.col("rule") == e) & _any([~F.map_contains_key("attrs", k) for k in r.required]) for e, r in rules.events.items() if r.required]
    low = [(F.col("rule") == e) & (F.col("rank") < rules.tiers.index(r.tier)) for e, r in rules.events.items()]
    reason = (
        F.when(~F.col("time").between(now - F.expr(PAST), now + F.expr(FUTURE)) | F.col("time").isNull(), "time").when(too_many(F.col("resource")) | too_many(F.col("record_attrs")), "attributes")
        .when(F.col("rule").isNull(), "event").when(F.col("said").isNull(), "tier").when(F.col("ceiling").isNull(), "tenant")
        .when((F.col("said") > F.col("ceiling")) & (F.col("mode") == "reject"), "consent").when(F.coalesce(_any(low), F.lit(False)), "consent").when(F.coalesce(_any(need), F.lit(False)), "required")
    )
    tier = F.element_at(F.array(*map(F.lit, rules.tiers)), F.col("rank") + 1)
    return rows.withColumn("reason", reason).withColumn("consent_tier", F.when(F.col("reason").isNull(), tier)).drop("res", "rec", "said", "ceiling", "resource", "record_attrs", "tier_ceiling", "mode")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason")


def reject_counts(rows: DataFrame) -> DataFrame:
    """Accepted and rejected records by reason (null: accepted), with one sample of each."""
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.first("rule", ignorenulls=True).alias("sample"))


def _text(key: str) -> Column:
    return F.nullif(F.col("attrs")[key]["s"], F.lit(""))


def plausible(c: Column, name: str) -> Column:
    low, high = PLAUSIBLE[name]
    return F.when(c.between(low, high), c)


def promoted(rows: DataFrame) -> DataFrame:
    """The common columns taken out of attrs; what is left as JSON."""
    number = lambda k: F.col("attrs")[k]["i"]
    code = F.least(F.greatest(number("cli.exit_code"), F.lit(-INT_MAX - 1)), F.lit(INT_MAX)).cast("int")
    out = rows.select("*", *(_text(k).alias(c) for c, k in PROMOTED.items()), code.alias("exit_code"), F.col("attrs")["cli.is_ci"]["b"].alias("is_ci"))
    sizes = {"peak_rss_bytes": "cli.peak_rss_bytes", "cpu_time_ms": "cli.cpu_time_ms", "binary_size_bytes": "cli.binary_size_bytes", "startup_ms": "cli.startup_ms"}
    out = out.select("*", *(plausible(number(k), c).alias(c) for c, k in sizes.items()))
    gone = [*PROMOTED.values(), "cli.exit_code", "cli.is_ci", *sizes.values()]
    plain = lambda v: F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"), F.to_json(v["a"]))
    quoted = lambda v: F.when(v["s"].isNotNull(), F.to_json(F.array(v["s"]))).otherwise(F.concat(F.lit("["), plain(v), F.lit("]")))

    def document(kept: Column) -> Column:
        # numbers and booleans stay what they are in the JSON text
        pairs = F.transform(F.map_entries(kept), lambda e: F.concat(F.substr(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.substr(quoted(e["value"]), F.lit(2), F.length(quoted(e["value"])) - 2)))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    left = F.map_filter("attrs", lambda k, _: ~k.isin(gone))
    own = lambda k: F.array_contains("own_keys", k)
    out = out.withColumn("attributes", document(F.map_filter(left, lambda k, _: own(k)))).withColumn("resource_attributes", document(F.map_filter(left, lambda k, _: ~own(k))))
    return out.drop("own_keys")


def span_rows(records: DataFrame, rules: Rules, tenants: DataFrame, now: Column) -> DataFrame:
    """Spans as trace rows, with reason; the partition time is the start."""
    r = records.select("tenant_id", "scope_name", "scope_version", "resource", F.col("record.attributes").alias("record_attrs"), nanos(F.col("record.startTimeUnixNano")).alias("time"),
                       nanos(F.col("record.endTimeUnixNano")).alias("end_time"), *(F.col(f"record.{a}").alias(b) for a, b in (("traceId", "trace_id"), ("spanId", "span_id"), ("parentSpanId", "parent_span_id"), ("name", "span_name"), ("kind", "span_kind"))),
                       F.col("record.status.code").alias("status_code"), F.col("record.status.message").alias("status_message"))
    r = r.withColumn("duration_ms", (F.unix_micros("end_time") - F.unix_micros("time")) / 1000.0)
    return promoted(evaluated(r, rules, F.col("span_name"), tenants, now)).withColumn("id", F.xxhash64("trace_id", "span_id")).drop("dims_sent")


def log_rows(records: DataFrame, rules: Rules, tenants: DataFrame, now: Column) -> DataFrame:
    """Log events as rows, with reason, and a fingerprint where an error was raised.

    The body stays only from tier full on, and where its event does not drop it.
    """
    r = records.select("tenant_id", "scope_name", "scope_version", "resource", F.col("record.attributes").alias("record_attrs"), nanos(F.col("record.timeUnixNano")).alias("time"),
                       *(F.col(f"record.{a}").alias(b) for a, b in (("severityNumber", "severity_number"), ("severityText", "severity_text"), ("eventName", "event_name"), ("traceId", "trace_id"), ("spanId", "span_id"))),
                       F.col("record.body.stringValue").alias("body"))
    rows = promoted(evaluated(r, rules, F.col("event_name"), tenants, now))
    drops = [e for e, x in rules.events.items() if x.drop_body]
    full = rules.tiers.index("full") if "full" in rules.tiers else len(rules.tiers)
    rows = rows.withColumn("body", F.when((F.col("rank") >= full) & ~F.coalesce(F.col("rule").isin(drops), F.lit(False)), F.nullif("body", F.lit(""))))
    raised = F.col("event_name") == "cli.error.raised"
    stack = _text("cli.error.stacktrace")
    rows = rows.withColumn("frames", F.when(raised & stack.isNotNull(), frames_of(stack)))
    message = F.when(raised, _text("cli.error.message"))
    by_stack = F.coalesce(F.size("frames"), F.lit(0)) > 0
    columns = {
        "error_message": message, "error_type": _text("cli.error.type"), "error_reason": _text("cli.error.reason"), "error_fingerprint": F.when(raised, fingerprint(message, F.col("frames"))),
        "top_frame": F.get("frames", 0), "suggestion": _text("cli.command.suggestion"), "feature": _text("cli.activation.feature"), "flags": F.col("attrs")["cli.flag.names"]["a"],
        "install_method": _text("cli.install.method"),
    }
    rows = rows.withColumns(columns).withColumn("error_source", F.when(F.col("error_fingerprint").isNotNull(), F.when(by_stack, "stack").otherwise("message")))
    # equal records get equal ids: an id only breaks ties of time
    return rows.withColumn("id", F.xxhash64("tenant_id", "time", "event_name", "install_id", "attributes", "body")).drop("frames", "dims_sent")


def metric_rows(records: DataFrame, rules: Rules, tenants: DataFrame, now: Column) -> DataFrame:
    """Metric points as rows, with reason: delta sums and histograms of the declared unit and bounds, and gauges."""
    m = F.col("record")
    head = ["tenant_id", "scope_name", "scope_version", "resource", m["name"].alias("metric_name"), m["unit"].alias("unit")]
    none = lambda kind: F.lit(None).cast(kind)
    number = lambda kind, temporality, monotonic, points: records.select(*head, F.lit(kind).alias("metric_type"), temporality.alias("temporality"), monotonic.alias("monotonic"), F.explode(points).alias("p")).select(
        "*", F.coalesce(F.col("p.asDouble"), F.col("p.asInt").try_cast("double")).alias("value"), none("long").alias("n"), none("double").alias("total"), none("double").alias("least"), none("double").alias("most"),
        none("array<bigint>").alias("counts"), none("array<double>").alias("bounds"), F.col("p.attributes").alias("record_attrs"), nanos(F.col("p.timeUnixNano")).alias("time"),
    ).drop("p")
    sums = number("sum", m["sum"]["aggregationTemporality"], m["sum"]["isMonotonic"], m["sum"]["dataPoints"])
    gauges = number("gauge", F.lit(1), F.lit(False), m["gauge"]["dataPoints"])
    h = records.select(*head, F.lit("histogram").alias("metric_type"), m["histogram"]["aggregationTemporality"].alias("temporality"), F.lit(False).alias("monotonic"), F.explode(m["histogram"]["dataPoints"]).alias("p"))
    hists = h.select(*[c for c in h.columns if c != "p"], none("double").alias("value"), F.col("p.count").try_cast("long").alias("n"), F.col("p.sum").alias("total"), F.col("p.min").alias("least"), F.col("p.max").alias("most"),
                     F.transform("p.bucketCounts", lambda x: x.try_cast("long")).alias("counts"), F.col("p.explicitBounds").alias("bounds"), F.col("p.attributes").alias("record_attrs"), nanos(F.col("p.timeUnixNano")).alias("time"))
    rows = evaluated(sums.unionByName(gauges).unionByName(hists), rules, F.col("metric_name"), tenants, now)
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) >= 0))
    shape = [(F.col("rule") == e) & (F.col("bounds") != F.array(*[F.lit(float(b)) for b in x.bounds])) for e, x in rules.events.items() if x.bounds]
    unit = [(F.col("rule") == e) & ~F.col("unit").eqNullSafe(x.unit) for e, x in rules.events.items() if x.unit]
    histogram = (F.size("counts") == F.size("bounds") + 1) & (F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) == F.col("n")) & finite("total") & finite("least") & finite("most")
    bad = (
        F.when((F.col("metric_type") != "gauge") & ~F.col("temporality").eqNullSafe(1), "temporality").when(F.coalesce(_any(unit), F.lit(False)), "unit").when(F.coalesce(_any(shape), F.lit(False)), "bounds")
        .when((F.col("metric_type") == "histogram") & ~F.coalesce(histogram, F.lit(False)), "histogram").when(F.col("monotonic") & ~F.coalesce(F.col("value").isNotNull() & finite("value"), F.lit(False)), "value")
    )
    rows = promoted(rows.withColumn("reason", F.coalesce("reason", bad)))
    # vendor instruments: name and label, dimensions folded into it; a histogram point brings all its observations
    named = reduce(lambda c, i: c.when(F.col("metric_name") == i, _text(f"{i}.name")), INSTRUMENTS, F.when(F.lit(False), ""))
    given = reduce(lambda c, i: c.when(F.col("metric_name") == i, _text(f"{i}.label")), INSTRUMENTS, F.when(F.lit(False), ""))
    label, wrong = folded_dims(F.col("attrs"), given, F.col("dims_sent"))
    vendor = F.col("metric_name").isin(list(INSTRUMENTS))
    rows = rows.withColumn("name", named).withColumn("label", F.when(vendor, label)).withColumn("reason", F.coalesce("reason", F.when(vendor & wrong, "dimensions")))
    at = [F.coalesce(F.get("counts", i), F.lit(0)).cast("long").alias(f"b{i}") for i in range(len(VALUE_BOUNDS) + 1)]
    rows = rows.withColumn("unit", F.coalesce(_text("cli.value.unit"), "unit")).withColumn("obs", F.col("value"))
    return rows.select("*", *at, F.xxhash64("tenant_id", "time", "metric_name", "name", "label", "install_id", "attributes").alias("id")).drop("dims_sent")


def folded_dims(attrs: Column, plain: Column, sent: Column, most: int = MOST_DIMS) -> tuple[Column, Column]:
    """Dimensions cli.dim.* and a plain label as one label, and whether they are invalid.

    They are where a dimension that was sent did not stay, where there are more than `most`, where a value or
    key would break the label, or where cli.dim.label stands beside a label.  Without dimensions the label is
    the plain one.
    """
    given = F.map_filter(attrs, lambda k, v: k.startswith(DIM_PREFIX) & v["s"].isNotNull())
    dims = F.map_from_entries(F.transform(F.map_entries(given), lambda e: F.struct(F.substring(e["key"], len(DIM_PREFIX) + 1, 1 << 20).alias("key"), e["value"]["s"].alias("value"))))
    clash = plain.isNotNull() & F.map_contains_key(dims, "label")
    every = F.when(plain.isNull() | clash, dims).otherwise(F.map_concat(dims, F.create_map(F.lit("label"), plain)))
    broken = F.exists(F.map_entries(dims), lambda e: (e["value"] == "") | e["value"].rlike("[;=]") | e["key"].rlike("[;=]"))
    wrong = (F.size(dims) < sent) | ((F.size(dims) > 0) & (clash | broken | (F.size(every) > most)))
    return F.when(F.size(dims) > 0, label_of(every)).otherwise(plain), wrong


def definition_versions(log: DataFrame) -> DataFrame:
    """Versions of definitions, each valid from its change to the next one of its metric.

    log: tenant_id, service_name, name, kind, dims (array), min_rank, changed_at, deprecated; one row a change, those of
    one metric few.  A deprecation ends a version and begins none.
    """
    w = W.partitionBy("tenant_id", "service_name", "name").orderBy("changed_at")
    rows = log.withColumn("valid_to", F.lead("changed_at").over(w)).withColumnRenamed("changed_at", "valid_from")
    return rows.filter(~F.coalesce("deprecated", F.lit(False))).drop("deprecated")


def checked_catalogue(points: DataFrame, declared: DataFrame, tenants: DataFrame, time: str = "time") -> DataFrame:
    """Points with reason and label after the tenant's catalogue as it stood at each point's time.

    declared: definition_versions.  A declared metric of another kind or below its tier is rejected; dimensions that
    it does not declare go; where the tenant is strict an undeclared metric is rejected, and one that is deprecated at
    the time counts as undeclared.  Points without kind, and those already rejected, are not looked up.
    """
    d = declared.select("tenant_id", F.col("service_name").alias("d_service"), F.col("name").alias("d_name"), F.col("kind").alias("d_kind"), "dims", "min_rank", "valid_from", "valid_to")
    strict = tenants.select("tenant_id", F.col("strict_metrics") if "strict_metrics" in tenants.columns else F.lit(False).alias("strict_metrics"))
    rows = points.join(strict, "tenant_id", "left")
    known = (rows["tenant_id"] == d["tenant_id"]) & rows["service_name"].eqNullSafe(d["d_service"]) & (rows["name"] == d["d_name"])
    then = (rows[time] >= d["valid_from"]) & (d["valid_to"].isNull() | (rows[time] < d["valid_to"]))
    rows = rows.join(d, known & then & rows["kind"].isNotNull(), "left").drop(d["tenant_id"])
    said = F.when(F.col("d_kind").isNull(), F.when(F.col("strict_metrics") & F.col("kind").isNotNull(), "undeclared")).when(F.col("d_kind") != F.col("kind"), "kind").when(F.col("rank") < F.col("min_rank"), "tier")
    kept = F.map_filter(dims_of(F.col("label")), lambda k, _: F.array_contains(F.col("dims"), k))
    label = F.when(F.col("dims").isNull() | F.col("label").isNull(), F.col("label")).otherwise(F.nullif(label_of(kept), F.lit("")))
    reason = F.coalesce("reason", said) if "reason" in points.columns else said
    return rows.withColumn("reason", reason).withColumn("label", label).drop("d_service", "d_name", "d_kind", "dims", "min_rank", "strict_metrics", "valid_from", "valid_to")


def append(rows: DataFrame, path: str, batch: int = -1, tenant_buckets: int = 8) -> None:
    """Accepted rows added to a fact table: date=.../tenant_bucket=.../batch=..., sorted for narrow reads.

    A micro-batch overwrites just its own partitions, so the same batch twice leaves one copy; without a
    number rows are added.  Date comes first, so retention drops whole folders.
    """
    out = rows.withColumn("date", F.to_date("time")).withColumn("tenant_bucket", F.pmod(F.hash("tenant_id"), F.lit(tenant_buckets))).withColumn("batch", F.lit(batch))
    sorted_rows = out.sortWithinPartitions("date", "tenant_bucket", "tenant_id", "time")
    writer = sorted_rows.write.mode("append") if batch < 0 else sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "tenant_bucket", "batch").parquet(path)
