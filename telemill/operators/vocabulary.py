"""Capped vocabularies: known names pass, new ones take free places, the rest become `other`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import dims_of, label_of
from ..sources.snapshots import Snapshot

OTHER = "other"
# Default caps.
CAPS = {"reasons": 100, "counters": 200, "measures": 100, "values": 100, "labels": 50, "dim_values": 50}


#: No cap is higher: ranks are cut here before rows are gathered by key.
MOST = 1000
# The tenant's column that overrides a cap.
OVERRIDES = {"reasons": "max_error_reasons", "counters": "max_counter_names", "measures": "max_measure_names", "values": "max_value_names"}


def cap_of(override: Column, everywhere: int | None, default: int) -> Column:
    """A tenant's own cap, else the deployment's, else the default."""
    return F.coalesce(override, F.lit(everywhere), F.lit(default))


def fresh(batch: DataFrame, known: DataFrame, keys: list[str], value: str, cap: int | Column, tenants: DataFrame | None = None) -> DataFrame:
    """Values of a batch that take the places that a key has left: most frequent in the batch first, then by name.

    `other` takes no place.  Counting comes first, so a hot key sends one row for each value and task; of those a
    task keeps the first MOST of a key, whatever number of names is sent.  cap may use columns of `tenants`.
    """
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    counts = batch.filter(F.col(value).isNotNull() & (F.col(value) != OTHER)).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    new = counts.join(known.select(*keys, value), [*keys, value], "left_anti")
    used = known.groupBy(*keys).agg(F.count("*").alias("__used"))
    order = W.partitionBy(*keys).orderBy(F.col("__n").desc(), value)
    ranked = new.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= MOST).join(used, keys, "left")
    if tenants is not None:
        ranked = ranked.join(tenants, "tenant_id", "left")
    return ranked.filter(F.col("__rank") + F.coalesce("__used", F.lit(0)) <= F.least(cap, F.lit(MOST))).select(*keys, value)


def admitted(batch: DataFrame, known: DataFrame, keys: list[str], value: str, cap: int | Column, tenants: DataFrame | None = None) -> DataFrame:
    """The vocabulary after a batch: keys, value; of one writer (see Vocabulary for several)."""
    return known.select(*keys, value).unionByName(fresh(batch, known, keys, value, cap, tenants))


class Vocabulary:
    """A capped vocabulary kept between the batches of any number of writers.

    A writer admits values on the version that it has read; if another one has published since, it plans again on
    that one's values, so no key ever has more than its cap.  Rows are rewritten by the version that holds the
    batch's own values: before they are appended, and alike when the batch runs again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], value: str) -> None:
        self.keys, self.value = list(keys), value
        self.table = Snapshot(spark, path, ", ".join(f"{k} string" for k in (*keys, value)) + ", last_seen timestamp", (*keys, value))

    def known(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def admit(self, batch: DataFrame, cap: int | Column, at: Column, stream: str, number: int, tenants: DataFrame | None = None) -> DataFrame:
        """The vocabulary by which this batch is rewritten: new values take free places, seen ones are touched once a day."""

        def plan(known: DataFrame) -> DataFrame:
            new = fresh(batch, known, self.keys, self.value, cap, tenants).withColumn("last_seen", at)
            old = touched(known, batch.filter(F.col(self.value).isNotNull()), [*self.keys, self.value], at)
            return new.unionByName(old.filter(F.col("touched")).drop("touched"))

        return self.known(self.table.changed(plan, stream, number))

    def sweep(self, cutoff: Column, alive: DataFrame | None = None) -> None:
        """Values not seen since the cutoff go, and values whose keys are not in `alive`; planned again if a writer was faster."""
        while True:
            on = self.table.version()
            kept = self.known(on).filter(F.col("last_seen") >= cutoff)
            if alive is not None:
                kept = kept.join(alive.distinct(), alive.columns, "left_semi")
            if on < 0 or self.table.publish(kept, on, whole=True):
                return


def capped(batch: DataFrame, vocabulary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The batch with values outside the vocabulary rewritten to `other`, and __folded where that happened."""
    v = vocabulary.select(*keys, value).withColumn("__known", F.lit(True))
    rows = batch.join(v, [*keys, value], "left")
    folded = F.col(value).isNotNull() & (F.col(value) != OTHER) & F.col("__known").isNull()
    return rows.withColumn("__folded", folded).withColumn(value, F.when(folded, OTHER).otherwise(F.col(value))).drop("__known")


def capped_metrics(batch: DataFrame, names: DataFrame, labels: DataFrame, name_cap: int, label_cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two levels: names, then labels under kept names.  Returns the rows and both vocabularies.

    A folded name, and one sent as `other`, lose their label; a folded label becomes `other`.
    """
    names = admitted(batch, names, ["tenant_id"], "name", name_cap)
    rows = capped(batch, names, ["tenant_id"], "name").withColumnRenamed("__folded", "name_folded")
    rows = rows.withColumn("label", F.when(F.col("name") != OTHER, F.col("label")))
    labels = admitted(rows.filter(F.col("name") != OTHER), labels, ["tenant_id", "name"], "label", label_cap)
    return capped(rows, labels, ["tenant_id", "name"], "label").withColumnRenamed("__folded", "label_folded"), names, labels


def capped_dimensions(batch: DataFrame, known: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Values of each dimension of labels capped within (tenant, name, key), before the labels themselves.

    Labels are rewritten once for each distinct one and joined back by value: rows get no numbers, so a batch
    that is computed twice may come in another order.
    """
    known = admitted(dimension_values(batch), known, ["tenant_id", "name", "key"], "value", cap)
    return rewritten_dimensions(batch, known, ["tenant_id", "name"]), known


def dimension_values(batch: DataFrame, keys: tuple[str, ...] = ("tenant_id", "name")) -> DataFrame:
    """keys, label, key and value of every dimension of the rows' labels."""
    return batch.filter("label is not null").select(*keys, "label", F.explode(dims_of(F.col("label"))).alias("key", "value"))


def rewritten_dimensions(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with dimension values outside `known` (keys, key, value) made `other` inside their label, and dim_folded."""
    parts = capped(dimension_values(batch.select(*keys, "label").distinct(), tuple(keys)), known, [*keys, "key"], "value")
    new = label_of(F.map_from_entries(F.collect_list(F.struct("key", "value"))))
    back = parts.groupBy(*keys, "label").agg(new.alias("__label"), F.bool_or("__folded").alias("dim_folded"))
    back = back.withColumnsRenamed({**{k: f"__{k}" for k in keys}, "label": "__old"})
    same = F.col("label") == F.col("__old")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = batch.join(back, same, "left").withColumn("label", F.coalesce("__label", "label")).withColumn("dim_folded", F.coalesce("dim_folded", F.lit(False)))
    return out.drop(*(f"__{k}" for k in keys), "__old", "__label")


def touched(vocabulary: DataFrame, seen: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """last_seen moved to `at` for values seen now, at most once a day, and whether it moved."""
    now = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    due = F.coalesce(F.col("__seen") & (F.col("last_seen") < at - F.expr("interval 1 day")), F.lit(False))
    rows = vocabulary.join(now, keys, "left").withColumn("touched", due)
    return rows.withColumn("last_seen", F.when(F.col("touched"), at).otherwise(F.col("last_seen"))).drop("__seen")
