"""Retention: expired partitions of facts and rollups, and state that outlived its data."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Files

# Days kept by default.
DAYS = {"traces": 30, "logs": 90, "metrics": 400, "hour": 90, "day": 730}


def expired_dates(spark: SparkSession, path: str, today: date, days: int) -> list[str]:
    """Partition folders date=... of a table that are older than its days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = (today - timedelta(days=days)).isoformat()
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in names if n.startswith("date=") and n[5:] < last)


def drop_expired(spark: SparkSession, path: str, today: date, days: int) -> list[str]:
    """Removes a table's expired partitions whole; nothing is rewritten."""
    gone = expired_dates(spark, path, today, days)
    jvm = spark.sparkContext._jvm
    for name in gone:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def drop_expired_of_tenants(spark: SparkSession, path: str, tenants: DataFrame, column: str, today: date) -> list[str]:
    """Rewrites just the (date, tenant_bucket) partitions that hold expired rows of tenants with `column` days; which ones.

    tenants: tenant_id and the days.  Such partitions are read, written without the expired rows beside the table, and
    swapped whole; partitions that lose all rows go, all others keep their files.  A job that is lost before the swap
    leaves the table as it was, one that is lost in it is finished by the next run.
    """
    files = Files(spark, path)
    for name in files.names(path):  # swaps that a lost run has left
        if name.startswith("_out-"):
            _swap(files, path, name)
        elif name.startswith("_new-"):
            files.delete(f"{path}/{name}")
    shorter = tenants.filter(F.col(column).isNotNull()).select("tenant_id", F.date_sub(F.lit(today), F.col(column)).alias("__from"))
    facts = spark.read.parquet(path)
    latest = shorter.agg(F.max("__from")).first()[0]
    if latest is None:
        return []
    old = facts.filter(F.col("date") < F.lit(latest)).join(shorter, "tenant_id", "left").withColumn("__gone", F.coalesce(F.col("date") < F.col("__from"), F.lit(False)))
    # some partitions a date: metadata
    hit = [(r.date.isoformat(), r.tenant_bucket) for r in old.filter("__gone").select("date", "tenant_bucket").distinct().collect()]
    if not hit:
        return []
    places = [f"date={d}/tenant_bucket={b}" for d, b in hit]
    own = uuid.uuid4().hex
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{p}" for p in places]).join(shorter, "tenant_id", "left")
    rows.filter(F.col("__from").isNull() | (F.col("date") >= F.col("__from"))).drop("__from").write.partitionBy("date", "tenant_bucket", "batch").parquet(f"{path}/_new-{own}")
    files.create(f"{path}/_new-{own}/_places", "\n".join(places))
    files.rename(f"{path}/_new-{own}", f"{path}/_out-{own}")  # from here on the swap is finished, by this run or the next
    _swap(files, path, f"_out-{own}")
    return places


def _swap(files: Files, path: str, name: str) -> None:
    """Puts the rewritten partitions in place of the old ones; may be run again at any point."""
    for place in files.read(f"{path}/{name}/_places").split("\n"):
        if not files.exists(f"{path}/{name}/{place}.done"):
            files.delete(f"{path}/{place}")
            if files.exists(f"{path}/{name}/{place}"):
                files.rename(f"{path}/{name}/{place}", f"{path}/{place}")
            files.create(f"{path}/{name}/{place}.done", "")
    files.delete(f"{path}/{name}")


def within_retention(rows: DataFrame, tenants: DataFrame, column: str, today: date, default: int, time: str = "time") -> DataFrame:
    """Rows inside their own tenant's retention (days in `column`, else the default)."""
    days = F.coalesce(F.col(column), F.lit(default))
    kept = rows.join(tenants.select("tenant_id", column), "tenant_id", "left").filter(F.to_date(time) >= F.date_sub(F.lit(today), days))
    return kept.drop(column)


def sweep_state(installs: DataFrame, changes: DataFrame, found: DataFrame, cutoff) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Installs last seen before the cutoff go, and with them their changes and discoveries."""
    kept = installs.filter(F.col("last_seen") >= F.lit(cutoff))
    keys = ["tenant_id", "install_id"]
    alive = kept.select(*keys)
    orphan = found.join(installs.select(*keys), keys, "left_anti").filter(F.col("first_at") >= F.lit(cutoff))
    return kept, changes.filter(F.col("changed_at") >= F.lit(cutoff)).join(alive, keys, "left_semi"), found.join(alive, keys, "left_semi").unionByName(orphan)
