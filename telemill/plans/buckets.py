"""Time buckets: hours, days, weeks from Monday and months, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "week", "month")


def bucket_of(grain: str, time: Column) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"no such bucket: {grain}")
    return F.date_trunc(grain, time)


def rebucket(grain: str, bucket: Column, stored: str) -> Column:
    """A stored bucket's coarser bucket; finer than what is stored is an error."""
    if grain not in GRAINS or GRAINS.index(grain) < GRAINS.index(stored):
        raise ValueError(f"{grain} buckets can't be made of {stored} buckets")
    return bucket if grain == stored else F.date_trunc(grain, bucket)


def stored_grain(grain: str) -> str:
    """The rollup that serves a bucket: hourly for hours, daily for the rest."""
    return "hour" if grain == "hour" else "day"


def periods_between(grain: str, first: Column, later: Column) -> Column:
    """How many buckets lie between two bucket starts."""
    if grain == "month":
        return (F.year(later) - F.year(first)) * 12 + F.month(later) - F.month(first)
    days = F.datediff(later, first)
    return days if grain == "day" else F.floor(days / 7).cast("int")
