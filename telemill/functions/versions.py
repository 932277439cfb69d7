"""Semantic versions as comparable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]*)?$"


def semver(version: Column) -> Column:
    """A struct that orders as versions do; null where it can't be read.

    One to three numbers, an optional leading v; a release is above its pre-releases; pre-release parts
    compare one by one, numbers by value and below words, fewer parts below more; a build is ignored.
    """
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(version, _SHAPE, k), F.lit("")).cast("decimal(38,0)"), F.lit(0))
    before = F.regexp_extract(version, _SHAPE, 4)
    part = lambda p: F.struct(
        (~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.try_cast("decimal(38,0)")).otherwise(0).cast("decimal(38,0)").alias("number"), p.alias("text")
    )
    plain = lambda p: F.struct(part(p)["word"].alias("word"), part(p)["number"].alias("number"), F.when(part(p)["word"], p).otherwise("").alias("text"))
    return F.when(
        version.rlike(_SHAPE),
        F.struct(
            number(1).cast("decimal(38,0)").alias("major"), number(2).cast("decimal(38,0)").alias("minor"), number(3).cast("decimal(38,0)").alias("patch"),
            (before == "").alias("release"), F.transform(F.split(before, r"\."), plain).alias("parts"),
        ),
    )


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either can't be read."""
    x, y = semver(a), semver(b)
    return F.when(x.isNull() | y.isNull(), None).when(x < y, -1).when(x > y, 1).otherwise(0)


def version_order(version: Column) -> list[Column]:
    """Sort keys: versions in their order, then other names, then null; equal versions by their text."""
    key = semver(version)
    return [F.when(version.isNull(), 2).when(key.isNull(), 1).otherwise(0).asc(), key.asc_nulls_last(), version.asc_nulls_last()]


def version_struct(version: Column) -> Column:
    """The same order as one comparable column, for sorting inside arrays."""
    key = semver(version)
    return F.struct(F.when(key.isNull(), 1).otherwise(0).alias("rank"), key.alias("key"), version.alias("version"))
