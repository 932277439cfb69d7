"""Rollups kept on disk: which date is stored where and up to when, reads that add the raw tail, refresh of dirty dates."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.buckets import stored_grain
from ..sources.snapshots import Files, Snapshot
from .rollups import Rollup, rollups

_ENTRIES = "rollup string, grain string, date date, folder string, through timestamp"


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


class Stored:
    """The stored rollups of one deployment.

    The catalogue has a row for each (rollup, grain, date): its folder (null where the date has no rows), and up to
    which time its buckets are whole.  A read takes a date's stored buckets and rolls up raw facts from there on, so
    it is right whatever is stored, and reads no raw partition of a date that is stored whole.  Days are stored only
    when they are over; they are made of stored hours.
    """

    def __init__(self, spark: SparkSession, path: str, facts: Callable[[str], DataFrame], rules: dict[str, Rollup] | None = None) -> None:
        self.spark, self.path, self.facts, self.rules = spark, path.rstrip("/"), facts, rules or rollups()
        self.files = Files(spark, self.path)
        self.catalogue = Snapshot(spark, f"{self.path}/catalogue", _ENTRIES, ("rollup", "grain", "date"))

    def _entries(self, name: str, grain: str) -> dict[date, tuple[str | None, datetime]]:
        """A row for each stored date: some hundreds."""
        rows = self.catalogue.read().filter((F.col("rollup") == name) & (F.col("grain") == grain)).collect()
        return {r.date: (r.folder, r.through) for r in rows}

    def _raw(self, r: Rollup, on: Column) -> DataFrame:
        """Facts of the dates that meet `on`, a condition on a date column; partitions of other dates are not read."""
        facts = self.facts(r.fact)
        return facts.filter(on) if "date" in facts.columns else facts.withColumn("date", F.to_date("time")).filter(on)

    def read(self, name: str, bucket: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """A rollup for buckets of a size: hourly where hours are asked for, else daily; of the dates from start to before end."""
        r = self.rules[name]
        grain = "day" if r.grain == "day" else stored_grain(bucket)
        asked = lambda d: (start is None or d >= start.date()) and (end is None or _midnight(d) < end)
        entries = {d: e for d, e in self._entries(name, grain).items() if asked(d)}
        whole = [d for d, (_, through) in entries.items() if through >= _midnight(d) + timedelta(days=1)]
        on = ~F.col("date").isin(whole) if whole else F.lit(True)
        on = on & (F.col("date") >= F.lit(start.date())) if start else on
        on = on & (F.to_timestamp("date") < F.lit(end)) if end else on
        raw = self._raw(r, on)
        for d, (_, through) in entries.items():
            if d not in whole:
                raw = raw.filter((F.col("date") != F.lit(d)) | (F.col("time") >= F.lit(through)))
        tail = r.build(raw)
        tail = r.merge(tail, grain) if grain != r.grain else tail
        paths = [f"{self.path}/{name}/{grain}/{folder}/date={d.isoformat()}" for d, (folder, _) in sorted(entries.items()) if folder]
        if not paths:
            return tail
        return self.spark.read.schema(tail.schema).parquet(*paths).unionByName(tail)

    def _write(self, rows: DataFrame, name: str, grain: str) -> tuple[str, set[str]]:
        folder = uuid.uuid4().hex
        place = f"{self.path}/{name}/{grain}/{folder}"
        rows.withColumn("date", F.to_date("bucket")).repartition("date").write.partitionBy("date").parquet(place)
        return folder, {n[5:] for n in self.files.names(place) if n.startswith("date=")}

    def refresh(self, dates: list[date], through: datetime, names: list[str] | None = None) -> None:
        """Aggregates just these dates anew, up to `through`, and publishes them at once; readers see the old or the new."""
        edge = through.replace(minute=0, second=0, microsecond=0)
        out = []
        for name in names or list(self.rules):
            r = self.rules[name]
            over = [d for d in dates if _midnight(d) + timedelta(days=1) <= edge]
            begun = over if r.grain == "day" else [d for d in dates if _midnight(d) < edge]
            if not begun:
                continue
            end = lambda d: min(edge, _midnight(d) + timedelta(days=1))
            made = r.build(self._raw(r, F.col("date").isin(begun)).filter(F.col("time") < F.lit(edge)))
            folder, full = self._write(made, name, r.grain)
            out += [(name, r.grain, d, folder if d.isoformat() in full else None, end(d)) for d in begun]
            if r.grain == "hour" and over:
                hours = [f"{self.path}/{name}/hour/{folder}/date={d.isoformat()}" for d in over if d.isoformat() in full]
                days = r.merge(self.spark.read.schema(made.schema).parquet(*hours), "day") if hours else r.merge(made.limit(0), "day")
                day_folder, day_full = self._write(days, name, "day")
                out += [(name, "day", d, day_folder if d.isoformat() in day_full else None, end(d)) for d in over]
        if out:
            rows = self.spark.createDataFrame(out, _ENTRIES)
            while not self.catalogue.publish(rows, self.catalogue.version()):
                pass

    # --- dirty dates

    def note(self, rows: DataFrame, signal: str, batch: int) -> None:
        """Records which (rollup, date) a batch of facts touches; to be called once the facts are appended."""
        mine = [r for r in self.rules.values() if r.fact == signal]
        touched = F.explode(F.filter(F.array(*[F.when(F.expr(r.takes), F.lit(r.name)) for r in mine]), lambda n: n.isNotNull())).alias("rollup")
        dirty = rows.select(touched, F.to_date("time").alias("date")).distinct()
        dirty.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/dirty/{signal}-{batch}")

    def pending(self) -> list[str]:
        """Batches whose dates have not been refreshed since."""
        return [n for n in self.files.names(f"{self.path}/dirty") if self.files.names(f"{self.path}/dirty/{n}")]

    def refresh_dirty(self, through: datetime) -> list[tuple[str, date]]:
        """Aggregates the (rollup, date) that batches have touched, and dates that time has completed since; what was refreshed.

        A batch's record goes once its dates are published: a job that is lost in between does them again.
        """
        batches = self.pending()
        todo: dict[str, set[date]] = defaultdict(set)
        if batches:
            for r in self.spark.read.schema("rollup string, date date").parquet(*[f"{self.path}/dirty/{b}" for b in batches]).distinct().collect():
                todo[r.rollup].add(r.date)
        edge = through.replace(minute=0, second=0, microsecond=0)
        for name, r in self.rules.items():
            for d, (_, held) in self._entries(name, r.grain).items():
                if held < min(edge, _midnight(d) + timedelta(days=1)):
                    todo[name].add(d)
        alike: dict[tuple[date, ...], list[str]] = defaultdict(list)
        for name, dates in todo.items():
            alike[tuple(sorted(dates))].append(name)
        for dates, names in alike.items():
            self.refresh(list(dates), through, names)
        # a date that has only begun after the last whole hour stays noted
        late = [b for b in batches if any(_midnight(r.date) >= edge for r in self.spark.read.parquet(f"{self.path}/dirty/{b}").select("date").distinct().collect())]
        for b in set(batches) - set(late):
            self.files.delete(f"{self.path}/dirty/{b}")
        return sorted((n, d) for n, dates in todo.items() for d in dates)

    def prune(self) -> None:
        """Removes folders that no entry names, when no older read is running."""
        live = {(r.rollup, r.grain, r.folder) for r in self.catalogue.read().select("rollup", "grain", "folder").distinct().collect()}
        for name, r in self.rules.items():
            for grain in {r.grain, "day"}:
                for folder in self.files.names(f"{self.path}/{name}/{grain}"):
                    if (name, grain, folder) not in live:
                        self.files.delete(f"{self.path}/{name}/{grain}/{folder}")
        self.catalogue.prune(1)
