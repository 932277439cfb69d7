"""Tables of state between micro-batches: every change is a version, published by creating its marker exclusively.

A version names the Parquet folders that make it up: a whole table, then the changed rows of later batches, of
which the last one holds for a key.  A writer reads a version, plans, writes its rows to a folder of its own and
publishes the next version; if that exists by now, another writer has won, and it plans again.  A version also
says which batch of which stream it holds last, so that a batch that runs again finds the state before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few calls on the table's file system, whichever it is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.hadoop = self.jvm.org.apache.hadoop
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(conf)
        self.context = self.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(root).toUri(), conf)

    def at(self, path: str):
        return self.fs.makeQualified(self.hadoop.fs.Path(path))

    def names(self, path: str) -> list[str]:
        place = self.at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, path: str) -> str:
        with_ = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def create(self, path: str, text: str) -> bool:
        """The whole file at once, or False if there is one already: a rename that overwrites nothing."""
        place = self.at(path)
        spare = self.at(f"{path}.{uuid.uuid4().hex}.tmp")
        self.fs.mkdirs(place.getParent())
        out = self.fs.create(spare, True)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.gateway.new_array(self.hadoop.fs.Options.Rename, 1)
        none[0] = self.hadoop.fs.Options.Rename.NONE
        try:
            self.context.rename(spare, place, none)
        except Exception as e:
            self.fs.delete(spare, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{old} could not become {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class Snapshot:
    """One table of state, a row for each key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], most_folders: int = 8) -> None:
        self.spark, self.path, self.schema, self.keys, self.most = spark, path.rstrip("/"), schema, list(keys), most_folders
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.path}/versions") if n.isdigit()]

    def version(self) -> int:
        """The newest version; -1 before the first."""
        return max(self.versions(), default=-1)

    def _marker(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/versions/{version:020d}")) if version >= 0 else {"folders": [], "batches": {}}

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._marker(self.version() if version is None else version)["folders"])

    def _rows(self, folders: list[str], more: DataFrame | None = None) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{f}") for f in folders] + ([more] if more is not None else [])
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return parts[0]
        names = parts[0].columns
        every = parts[0].withColumn("__n", F.lit(0))
        for k, p in enumerate(parts[1:], 1):
            every = every.unionByName(p.withColumn("__n", F.lit(k)))
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in names if c not in self.keys]), "__n").alias("__last"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"__last.{c}").alias(c) for c in names])

    def holding(self, stream: str, batch: int) -> int | None:
        """The version that a stream's batch has published; None if it has not."""
        found = None
        for v in reversed(self.versions()):
            if self._marker(v)["batches"].get(stream, -1) < batch:
                break
            found = v
        return found

    def before(self, stream: str, batch: int) -> int:
        """The version that stood before a batch, also where the batch runs again."""
        held = self.holding(stream, batch)
        return self.version() if held is None else held - 1

    def publish(self, rows: DataFrame | None, on: int, stream: str | None = None, batch: int = -1, whole: bool = False) -> bool:
        """The version after `on` with changed rows (or with the whole table); False if another writer has published it."""
        marker = self._marker(on)
        folders = marker["folders"]
        if whole or (rows is not None and len(folders) + 1 > self.most):
            rows, folders = rows if whole else self._rows(folders, rows), []
        own = uuid.uuid4().hex
        if rows is not None:
            rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]).write.parquet(f"{self.path}/rows/{own}")
            folders = [*folders, own]
        batches = marker["batches"] | ({stream: batch} if stream is not None else {})
        if self.files.create(f"{self.path}/versions/{on + 1:020d}", json.dumps({"folders": folders, "batches": batches})):
            return True
        self.files.delete(f"{self.path}/rows/{own}")
        return False

    def changed(self, plan: Callable[[DataFrame], DataFrame | None], stream: str, batch: int, tries: int = 100) -> int:
        """Publishes plan(state) for a batch, planned again whenever another writer was faster; the version that holds it.

        A batch that is held already is not planned again.
        """
        for _ in range(tries):
            held = self.holding(stream, batch)
            if held is not None:
                return held
            on = self.version()
            if self.publish(plan(self.read(on)), on, stream, batch):
                return on + 1
        raise RuntimeError(f"{self.path}: {tries} other writers were faster")

    def prune(self, keep: int = 8) -> None:
        """Removes versions older than the last `keep`, and the folders that only they name."""
        versions = self.versions()
        live = {f for v in versions[-keep:] for f in self._marker(v)["folders"]}
        old = {f for v in versions[:-keep] for f in self._marker(v)["folders"]} - live
        for v in versions[:-keep]:
            self.files.delete(f"{self.path}/versions/{v:020d}")
        for f in old:
            self.files.delete(f"{self.path}/rows/{f}")
