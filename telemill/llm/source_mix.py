"""Mixing sources to target weights: a low-discrepancy schedule of slots, each one block of a source's shuffled words.

A source's documents, shuffled by a hash, stand end to end and are cut into blocks of as many words.  Its target
asks for a number of slots.  Slot j's point is frac(j g / M) for M slots and a g coprime to M beside the golden
section of M: the golden-ratio sequence, brought to M equal steps so that each is met once.
Points go through the sources' cumulative slots, so every source gets exactly its slots, spread evenly.  The r-th
slot of a source takes its r-th block, beginning again after the last one; its last slot is cut to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Weights of the sources by code point, repeating; the mix's size as a share of all; times that a source may be taken.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words of a block; slots that one row is exploded to.
BLOCK, CHUNK = 1024, 4096
GOLDEN = (math.sqrt(5) - 1) / 2
SEED = 1


def sized(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """(source, doc_id, size, copies): rows that agree in all three are interchangeable and are one row from here on."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")) if size is None else size
    return docs.select("source", "doc_id", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))


def running(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """rows with `number` (from 0) and `before` (the sum of earlier values) in a global order, without a task for all.

    Rows are dealt by range; each part's totals, one row a part, are added up.
    """
    parts = staged(rows.withColumn("__v", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    total = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__v").alias("__sum"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum"))
    own = W.partitionBy("__part").orderBy(*order)
    out = parts.withColumn("number", F.row_number().over(own) - 1).withColumn("before", F.sum("__v").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("__v"))
    out = out.join(total, "__part").withColumn("number", F.col("number") + F.col("__n")).withColumn("before", F.col("before") + F.col("__sum"))
    return out.drop("__part", "__v", "__n", "__sum")


def targets(work: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sid (number of the source by code point, null last), source, source_size and target of every source.

    The targets share `share` of all words by weight.  A target stops at `most` times its source, and what is
    over goes to the others by weight, until none is above: each round is one sum over the sources.
    """
    sizes = work.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ranked = running(sizes, [F.col("source").isNull(), F.col("source")], F.lit(0))
    kinds = F.array(*map(F.lit, weights))
    s = staged(ranked.select(F.col("number").alias("sid"), "source", "source_size", F.get(kinds, F.col("number") % len(weights)).alias("weight")))
    whole = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, full = -1.0, lambda level: most * F.col("source_size") < level * F.col("weight")
    while True:
        used, open_ = s.agg(F.coalesce(F.sum(F.when(full(level), most * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full(level), F.col("weight"))), F.lit(0.0))).first()
        new = (whole - used) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return s.select("sid", "source", "source_size", F.least(most * F.col("source_size"), level * F.col("weight")).cast("double").alias("target"))


def golden_step(m: int) -> int:
    """A number coprime to m beside m's golden section: of those within 32 the one whose steps stay the most even.

    How even they are is told by the greatest partial quotient of its continued fraction, which is 1 for the golden ratio.
    """
    near, best = round(m * GOLDEN), (m, m, 1)
    for g in range(max(1, near - 32), min(m, near + 33)):
        a, b, quotients = m, g, []
        while b:
            quotients.append(a // b)
            a, b = b, a % b
        if a == 1:
            best = min(best, (max([*quotients[:-1], quotients[-1] - 1]), abs(g - near), g))
    return best[2]


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, block, take): which block of which source each slot takes, and how many words of it.

    Ranks within a source are numbers within a stretch of the schedule plus the slots of earlier stretches; the
    square root of the number of slots is both a stretch's length and the number of stretches.
    """
    budget = F.floor("target").cast("long")
    s = sources.filter("source_size > 0").withColumn("passes", F.floor(budget / F.col("source_size")).cast("long"))
    s = s.withColumn("rest", budget - F.col("passes") * F.col("source_size")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")).filter("need > 0")
    s = staged(running(s, [F.col("sid")], F.col("need")).drop("number"))
    m = s.agg(F.sum("need")).first()[0] or 1
    stretch = math.isqrt(m) + 1
    whole = lambda c: c.cast("decimal(19,0)")
    # two steps, so that a source with very many slots is neither one array nor one task
    low = s.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1, F.lit(CHUNK).cast("long")))).repartition("sid", "low")
    point = low.withColumn("point", F.explode(F.sequence("low", F.least(F.col("low") + CHUNK, "need") - 1))).withColumn("point", F.col("before") + F.col("point"))
    slot = ((whole(F.col("point")) * whole(F.lit(pow(golden_step(m), -1, m)))) % whole(F.lit(m))).cast("long")
    slots = staged(point.select(slot.alias("slot"), "sid", "source_size", "blocks", "passes", "rest").withColumn("stretch", F.floor(F.col("slot") / stretch).cast("long")))
    earlier = slots.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    earlier = earlier.select("sid", "stretch", (F.sum("n").over(W.partitionBy("sid").orderBy("stretch")) - F.col("n")).alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(W.partitionBy("sid", "stretch").orderBy("slot")) - 1
    ranked = slots.join(earlier, ["sid", "stretch"]).withColumn("rank", rank)
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("round", F.floor(F.col("rank") / F.col("blocks")))
    left = F.when(F.col("round") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest")) - F.col("block") * block
    return ranked.select("slot", "sid", "block", F.least(F.lit(block).cast("long"), left, F.col("source_size") - F.col("block") * block).alias("take"))


def blocks_of(work: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(sid, doc_id, size, copy, block, at, first, words): the words of each document that lie in each block.

    at: where in the block they begin; first: which word of the document that is.  A document without words
    has one row without a block.  A source's documents stand by a hash of the id; the hash's buckets, as many as
    the square root of the rows, are ordered by themselves, after the words of the earlier buckets.
    """
    buckets = math.isqrt(max(1, work.count()))
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    same = work["source"].eqNullSafe(sources["source"])
    rows = staged(work.join(sources, same).select("sid", "doc_id", "size", "copies", h.alias("h"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(buckets)).alias("bucket")))
    words = F.col("size") * F.col("copies")
    earlier = rows.groupBy("sid", "bucket").agg(F.sum(words).alias("n"))
    earlier = earlier.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("earlier"))
    own = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.join(earlier, ["sid", "bucket"]).withColumn("begin", F.col("earlier") + F.sum(words).over(own) - words)
    each = placed.select("sid", "doc_id", "size", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    each = each.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")).withColumn("end", F.col("begin") + F.col("size"))
    number = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long")))
    out = each.withColumn("block", F.explode_outer(number)).withColumn("from", F.greatest("begin", F.col("block") * block)).withColumn("to", F.least("end", (F.col("block") + 1) * block))
    return out.select("sid", "doc_id", "size", "copy", "block", (F.col("from") - F.col("block") * block).alias("at"), (F.col("from") - F.col("begin")).alias("first"), F.when(F.col("size") > 0, F.col("to") - F.col("from")).alias("words"))


def _joined(work: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Every piece of a document with every slot that takes its block; `got`: the words of it that are taken."""
    pieces = blocks_of(work, sources, block)
    got = F.when(F.col("take") > F.col("at"), F.least(F.col("words"), F.col("take") - F.col("at"))).otherwise(F.lit(0).cast("long"))
    return pieces.join(schedule(sources, block), ["sid", "block"], "left").withColumn("got", got)


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """The mix itself: (slot, at, source, doc_id, first, words); in the order of slot and at it is the training order.

    Each row is `words` words of a document from word `first` on.  Reruns agree.
    """
    work = staged(sized(docs, size))
    sources = targets(work, weights, share, most)
    return _joined(work, sources, block).filter("got > 0").join(sources.select("sid", "source"), "sid").select("slot", "at", "source", "doc_id", "first", F.col("got").alias("words"))


def taken(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix, repeats counted) of every row.

    A null or empty text has size 0 and is not taken; a null source is a source of its own, the last one; a row
    given twice is two documents.  A source's taken words are its target's whole part, so no document exceeds
    `most` times its size where that is a whole number.  Texts of any length lie in as many blocks as they need.  No rows give no rows.
    """
    work = staged(sized(docs, size))
    sources = targets(work, weights, share, most)
    sums = _joined(work, sources, block).groupBy("sid", "doc_id", "size", "copy").agg(F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken"))
    return sums.join(sources, "sid").select("doc_id", "size", "source_size", "target", "taken")
