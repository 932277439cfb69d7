"""Who may see what and when: tenant, half-open time range, filters (or within one, and across), paging."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST_LIMIT = 100, 1000
LONGEST_RANGE = timedelta(days=90)
#: In place of a tenant: every tenant at once, each one's rows for itself, told by tenant_id.
EVERY = "*"
MOST_PATTERNS, LONGEST_PATTERN, MOST_DIMENSIONS = 3, 128, 8


def attribute(name: str, column: str = "attributes") -> Column:
    """The text of a JSON attribute whose name may hold dots; null if absent or a JSON null."""
    return F.get_json_object(column, "$['" + name.replace("'", "\\'") + "']")


def json_number(name: str, column: str = "attributes") -> Column:
    """A JSON attribute as a double where it is a number; null for a numeric string, any other type or none."""
    value = F.variant_get(F.try_parse_json(column), "$['" + name.replace("'", "\\'") + "']", "variant")
    return F.when(F.schema_of_variant(value).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def dimension(label: Column, key: str) -> Column:
    """A key's value in a label k1=v1;k2=v2: 'other' is other for every key, a label without '=' is dimension label."""
    if not key or any(c in key for c in "=;"):
        raise ValueError(f"not a dimension: {key!r}")
    found = F.regexp_extract(label, "(?:^|;)" + re.escape(key) + "=([^;]*)", 1)
    plain = F.when(F.lit(key == "label") & ~F.contains(label, F.lit("=")) & (label != ""), label)
    return F.when(label == "other", "other").otherwise(F.coalesce(plain, F.nullif(found, F.lit(""))))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class Filters:
    """What every query takes; empty lists and None do not filter."""

    tenant_id: str
    start: datetime
    end: datetime
    versions: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()
    archs: tuple[str, ...] = ()
    commands: tuple[str, ...] = ()
    services: tuple[str, ...] = ()
    exit_code: int | None = None
    is_ci: bool | None = None
    equals: dict[str, str] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    matches: dict[str, str] = field(default_factory=dict)
    among: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exists: tuple[str, ...] = ()
    where: dict[str, tuple[str, ...]] = field(default_factory=dict)
    label: str | None = None
    limit: int = 0
    offset: int = 0

    def __post_init__(self) -> None:
        if not self.tenant_id:
            raise ValueError("a query needs a tenant")
        if self.end < self.start or self.end - self.start > LONGEST_RANGE:
            raise ValueError("the time range must be forward and at most 90 days")
        if len(self.matches) > MOST_PATTERNS or any(len(p) > LONGEST_PATTERN for p in self.matches.values()):
            raise ValueError(f"at most {MOST_PATTERNS} patterns of {LONGEST_PATTERN} characters")
        if len(self.where) > MOST_DIMENSIONS:
            raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")

    @property
    def rows(self) -> int:
        return DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MOST_LIMIT)

    @property
    def keys(self) -> tuple[str, ...]:
        """What every grouping, join and rank has beside its own keys: nothing for one tenant, tenant_id for every tenant."""
        return ("tenant_id",) if self.tenant_id == EVERY else ()

    def tenant(self) -> Column:
        return F.lit(True) if self.keys else F.col("tenant_id") == self.tenant_id

    def time(self, column: str = "time") -> Column:
        return (F.col(column) >= F.lit(self.start)) & (F.col(column) < F.lit(self.end))

    def any_of(self, *names: str) -> list[Column]:
        """Conditions on the named dimensions among cli_version, os, arch, command_name, service_name, is_ci, exit_code."""
        lists = {"cli_version": self.versions, "os": self.systems, "arch": self.archs, "command_name": self.commands, "service_name": self.services}
        single = {"is_ci": self.is_ci, "exit_code": self.exit_code}
        some = [F.col(n).isin(list(lists[n])) for n in names if lists.get(n)]
        return some + [F.col(n) == single[n] for n in names if single.get(n) is not None]

    def attributes(self) -> list[Column]:
        out = [attribute(k) == v for k, v in self.equals.items()]
        out += [F.contains(attribute(k), F.lit(v)) for k, v in self.contains.items()]
        out += [attribute(k).rlike(v) for k, v in self.matches.items()]
        out += [attribute(k).isin(list(v)) for k, v in self.among.items()]
        return out + [attribute(k).isNotNull() for k in self.exists]

    def dimensions(self, label: str) -> list[Column]:
        return [dimension(F.col(label), k).isin(list(v)) for k, v in self.where.items()]

    def check_patterns(self, spark: SparkSession) -> None:
        """Raises for a malformed pattern even where there are no rows."""
        for p in self.matches.values():
            spark.range(1).select(F.lit("").rlike(p)).collect()

    def whole(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        """One row of aggregates, or one for each tenant."""
        return df.groupBy(*self.keys).agg(*aggregates) if self.keys else df.agg(*aggregates)

    def beside(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of whole() on the right put beside those on the left: of the same tenant, or the only row."""
        return left.join(right, list(self.keys), "left") if self.keys else left.crossJoin(right)

    def page(self, df: DataFrame, *order: Column, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """The page in this order; for every tenant that of each, by its rank among the tenant's rows."""
        skip, most = self.offset if offset is None else offset, limit or self.rows
        if not self.keys:
            return df.orderBy(*order).offset(skip).limit(most)
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))
        return df.withColumn("__rank", rank).filter((F.col("__rank") <= skip + most) & (F.col("__rank") > skip)).drop("__rank")


def facts(df: DataFrame, f: Filters, *dims: str, events: tuple[str, ...] = (), install: bool = False) -> DataFrame:
    """Raw rows in scope."""
    conditions = [f.tenant(), f.time(), *f.any_of(*dims)]
    if events:
        conditions.append(F.col("event_name").isin(list(events)))
    if install:
        conditions.append(F.col("install_id").isNotNull())
    return df.filter(all_of(conditions))


def rollup(df: DataFrame, f: Filters, *dims: str) -> DataFrame:
    """Rollup rows whose bucket starts in the range."""
    return df.filter(all_of([f.tenant(), f.time("bucket"), *f.any_of(*dims)]))
