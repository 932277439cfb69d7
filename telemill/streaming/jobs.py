"""Streams: export files into fact tables with all derived state, and rollups from hours to days in one query."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import installs, maintenance, vocabulary
from ..operators.ingest import INSTRUMENTS, Rules, accepted, append, checked_catalogue, log_rows, metric_rows, reject_counts, span_rows
from ..operators.stored import Stored
from ..operators.vocabulary import CAPS, OVERRIDES, Vocabulary, cap_of
from ..sources.snapshots import Files, Snapshot

LATE = "1 day"
BUILD = {"logs": log_rows, "traces": span_rows, "metrics": metric_rows}
#: Rows of `folds`: values that a cap turned into `other`.
FOLDS = "tenant_id string, kind string, cap string, date date, n bigint"


class Telemetry:
    """The tables of a deployment under one folder, and the streams that keep them.

    A micro-batch is validated, checked against the catalogue, capped and appended; then its dirty dates, and the
    state of installs, are derived.  Each step either overwrites what the same batch wrote before or is skipped when
    the batch's version stands already, and the batch's own time is stored with its first try: a batch that runs
    again leaves every table as it was.  Several streams may write at once.
    """

    def __init__(self, spark: SparkSession, root: str, rules: Rules, tenants: DataFrame, definitions: DataFrame | None = None, caps: dict[str, int] | None = None, name: str = "") -> None:
        self.spark, self.root, self.rules, self.tenants, self.definitions = spark, root.rstrip("/"), rules, tenants, definitions
        self.everywhere, self.name = caps or {}, name
        self.files = Files(spark, self.root)
        state = f"{self.root}/state"
        self.installs = Snapshot(spark, f"{state}/installs", installs.MARKS, ("tenant_id", "install_id"))
        self.discoveries = Snapshot(spark, f"{state}/discoveries", "tenant_id string, install_id string, kind string, name string, first_at timestamp", ("tenant_id", "install_id", "kind", "name"))
        self.reasons = Vocabulary(spark, f"{state}/reasons", ("tenant_id",), "error_reason")
        self.names = Vocabulary(spark, f"{state}/names", ("tenant_id", "kind"), "name")
        self.labels = Vocabulary(spark, f"{state}/labels", ("tenant_id", "kind", "name"), "label")
        self.dim_values = Vocabulary(spark, f"{state}/dim_values", ("tenant_id", "kind", "name", "key"), "value")
        self.rollups = Stored(spark, f"{self.root}/rollups", self.facts)

    def facts(self, signal: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/facts/{signal}")

    def changes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/changes").drop("batch")

    def install_states(self) -> DataFrame:
        return installs.states_of(self.installs.read())

    def folds(self) -> DataFrame:
        """Values folded by caps, of all batches."""
        found = [f"{self.root}/folds/{n}" for n in self.files.names(f"{self.root}/folds")]
        return self.spark.read.schema(FOLDS).parquet(*found) if found else self.spark.createDataFrame([], FOLDS)

    def _time(self, signal: str, batch: int, now: datetime) -> datetime:
        """The time of the batch's first try."""
        place = f"{self.root}/times/{self.name}{signal}-{batch}"
        self.files.create(place, now.isoformat())
        return datetime.fromisoformat(self.files.read(place))

    def _cap(self, kind: str) -> Column:
        """A tenant's own cap, else the deployment's, else the default."""
        own = OVERRIDES.get(kind)
        return cap_of(F.col(own) if own in self.tenants.columns else F.lit(None).cast("int"), self.everywhere.get(kind), CAPS[kind])

    def _capped_logs(self, rows: DataFrame, at: Column, stream: str, batch: int) -> DataFrame:
        known = self.reasons.admit(accepted(rows), self._cap("reasons"), at, stream, batch, self.tenants)
        return vocabulary.capped(rows, known, ["tenant_id"], "error_reason").withColumnRenamed("__folded", "reason_folded")

    def _capped_metrics(self, rows: DataFrame, at: Column, stream: str, batch: int) -> DataFrame:
        """Dimension values first, then names, then the labels under names that stay; vendor instruments only."""
        good = lambda rows: accepted(rows).filter("kind is not null")
        keys = ["tenant_id", "kind", "name"]
        values = self.dim_values.admit(vocabulary.dimension_values(good(rows), tuple(keys)), self._cap("dim_values"), at, stream, batch, self.tenants)
        rows = vocabulary.rewritten_dimensions(rows, values, keys)
        by_kind = F.coalesce(*[F.when(F.col("kind") == k, self._cap(f"{k}s")) for k in ("counter", "measure", "value")])
        names = self.names.admit(good(rows), by_kind, at, stream, batch, self.tenants)
        rows = vocabulary.capped(rows, names, ["tenant_id", "kind"], "name").withColumnRenamed("__folded", "name_folded")
        rows = rows.withColumn("name_folded", F.col("name_folded") & F.col("kind").isNotNull()).withColumn("label", F.when(F.col("name") != vocabulary.OTHER, F.col("label")))
        labels = self.labels.admit(good(rows).filter(F.col("name") != vocabulary.OTHER), self._cap("labels"), at, stream, batch, self.tenants)
        return vocabulary.capped(rows, labels, keys, "label").withColumnRenamed("__folded", "label_folded")

    def write(self, signal: str, records: DataFrame, batch: int, now: datetime | None = None) -> None:
        """One batch of a signal's records (otlp.read, with tenant_id); the same batch again changes nothing."""
        at = F.lit(self._time(signal, batch, now or datetime.now(timezone.utc).replace(tzinfo=None)))
        stream = f"{self.name}{signal}"
        rows = BUILD[signal](records, self.rules, self.tenants, at)
        folds: dict[str, str] = {}
        if signal == "metrics":
            kind = F.when(F.col("metric_name").isin(list(INSTRUMENTS)), F.substring("metric_name", 5, 100))
            rows = rows.withColumn("kind", kind)
            rows = checked_catalogue(rows, self.definitions, self.tenants) if self.definitions is not None else rows
        valid = rows.persist()  # read by every cap; made again where an executor is lost
        if signal == "metrics":
            rows = self._capped_metrics(rows, at, stream, batch)
            folds = {"dim_values": "dim_folded", "names": "name_folded", "labels": "label_folded"}
        elif signal == "logs":
            rows = self._capped_logs(rows, at, stream, batch).withColumn("kind", F.lit(None).cast("string"))
            folds = {"reasons": "reason_folded"}
        rows.persist()
        try:
            good = accepted(rows)
            append(good.drop(*folds.values(), *(["kind"] if signal == "logs" else [])), f"{self.root}/facts/{signal}", batch)
            reject_counts(rows).write.mode("overwrite").parquet(f"{self.root}/rejects/{stream}-{batch}")
            if folds:
                cap = F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(k)) for k, c in folds.items()]), lambda k: k.isNotNull())).alias("cap")
                over = good.select("tenant_id", "kind", cap, F.to_date("time").alias("date")).groupBy("tenant_id", "kind", "cap", "date").agg(F.count("*").alias("n"))
                over.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folds/{stream}-{batch}")
            self.rollups.note(good, signal, f"{self.name}{batch}")
            if signal == "logs":
                self._derive(good, stream, batch)
        finally:
            rows.unpersist()
            valid.unpersist()

    def _derive(self, events: DataFrame, stream: str, batch: int) -> None:
        """Version changes against the state before the batch, then that state and first uses with the batch."""
        events = events.filter("install_id is not null")
        before = self.installs.read(self.installs.before(stream, batch))
        installs.version_changes(events, before).write.mode("overwrite").parquet(f"{self.root}/changes/batch={stream}-{batch}")
        keys = ["tenant_id", "install_id"]

        def plan(state: DataFrame) -> DataFrame:
            new = installs.install_marks(events)
            return installs.merge_marks(state.join(new.select(*keys), keys, "left_semi"), new)

        self.installs.changed(plan, stream, batch)

        def first(state: DataFrame) -> DataFrame:
            found = installs.discoveries(events, "flags")
            had = state.withColumnRenamed("first_at", "__had")
            return found.join(had, [*keys, "kind", "name"], "left").filter(F.col("__had").isNull() | (F.col("first_at") < F.col("__had"))).drop("__had")

        self.discoveries.changed(first, stream, batch)

    def stream(self, signal: str, records: DataFrame, checkpoint: str) -> StreamingQuery:
        """The stream of a signal's records through write()."""
        return records.writeStream.foreachBatch(lambda rows, n: self.write(signal, rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def retain(self, today: date) -> dict[str, list[str]]:
        """Drops expired partitions of every fact table, and of tenants that keep theirs for a shorter time; stored rollups forget expired dates, and old versions of state go."""
        gone = {}
        for signal in BUILD:
            path = f"{self.root}/facts/{signal}"
            if not self.files.names(path):
                continue
            gone[signal] = maintenance.drop_expired(self.spark, path, today, maintenance.DAYS[signal])
            if f"{signal}_days" in self.tenants.columns:
                gone[signal] += maintenance.drop_expired_of_tenants(self.spark, path, self.tenants, f"{signal}_days", today)
        for table in (self.installs, self.discoveries, self.rollups.catalogue, *(v.table for v in (self.reasons, self.names, self.labels, self.dim_values))):
            table.prune()  # versions that no batch can ask for any more
        keep = F.when(F.col("grain") == "hour", maintenance.DAYS["hour"]).otherwise(maintenance.DAYS["day"])
        while True:
            on = self.rollups.catalogue.version()
            kept = self.rollups.catalogue.read(on).filter(F.col("date") >= F.date_sub(F.lit(today), keep))
            if on < 0 or self.rollups.catalogue.publish(kept, on, whole=True):
                return gone

    def sweep(self, cutoff: datetime) -> None:
        """State that nobody has sent since the cutoff: reasons, names, labels and dimension values (which go with their name)."""
        at = F.lit(cutoff)
        self.reasons.sweep(at)
        self.names.sweep(at)
        names = self.names.known().select("tenant_id", "kind", "name")
        self.labels.sweep(at, names)
        self.dim_values.sweep(at, names)


def sessions(runs: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a stream of runs, closed by the gap."""
    out = runs.withWatermark("time", LATE).groupBy(F.session_window("time", gap), "tenant_id", "install_id").agg(F.count("*").alias("runs"))
    return out.select("tenant_id", "install_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("closed"), "runs")
