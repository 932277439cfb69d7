"""Token counts kept as additive totals by source, language and tokenizer version.

A change carries a document's counts before and after it: an insert has no before, a delete no after, a
revision both.  A batch of changes becomes a small table of signed sums.  It is written beside the store
and moved into place under its batch number, so a batch is there whole or not at all, and one that is
committed again changes nothing.  Totals are the sum over all batches.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Files
from .common import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTED = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, source, lang and n_tokens of every row's whole text; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in slices(batches, "text"):
            n = pa.array([len(encode(t)) if t else 0 for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang", "digest")), n], ["doc_id", "source", "lang", "digest", "n_tokens"])

    some = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("digest"), "text")
    return some.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, lang string, digest long, n_tokens long")


def counted(source: Column, lang: Column, tokenizer: Column, n_tokens: Column) -> Column:
    """A count of one document, for the before or after of a change."""
    return F.struct(source.alias("source"), lang.alias("lang"), tokenizer.alias("tokenizer"), n_tokens.cast("long").alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (before, after), zero sums left out.

    Null languages or sources are groups of their own; a null count adds its document and no tokens; a
    change with neither side is nothing.  Each task adds up first, so a hot source is one row per task.
    """
    sided = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("c")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("c")))).alias("x"))
    parts = sided.filter("x.c is not null").select("x.sign", "x.c.*")
    sums = parts.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("long").alias("docs"), F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).cast("long").alias("tokens"))
    return sums.filter("docs <> 0 or tokens <> 0")


class Rollup:
    """A store of batches in a folder of any file system that Spark writes; any number of writers.

    A batch's sums are written to a folder of their own, and the batch is committed by creating the marker of its
    number, which names that folder: of writers of one number just the first one counts, and a lost one leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def _marker(self, batch: int) -> str:
        return f"{self.path}/batches/{batch:012d}"

    def committed(self, batch: int) -> bool:
        return self.files.exists(self._marker(batch))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch; False, and nothing done, if that number is there already."""
        if self.committed(batch):
            return False
        own = uuid.uuid4().hex
        deltas(changes).write.parquet(f"{self.path}/rows/{own}")
        if self.files.create(self._marker(batch), own):
            return True
        self.files.delete(f"{self.path}/rows/{own}")
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that came back to nothing are left out."""
        folders = [self.files.read(f"{self.path}/batches/{n}") for n in self.files.names(f"{self.path}/batches") if n.isdigit()]
        if not folders:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        rows = self.spark.read.schema(DELTAS).parquet(*[f"{self.path}/rows/{f}" for f in folders])
        sums = rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def history(counts: DataFrame, first: str, second: str) -> list[tuple[int, DataFrame]]:
    """Batches of a corpus' life, from counts (doc_id, source, lang, digest, n_tokens).

    1: every document comes in under the first tokenizer version.  2: copies of a smaller doc_id's text go.
    3: what is left in French is counted again by the second version, which also counts an end token.
    """
    none = F.lit(None).cast(COUNTED)
    old = counted(F.col("source"), F.col("lang"), F.lit(first), F.col("n_tokens"))
    new = counted(F.col("source"), F.col("lang"), F.lit(second), F.col("n_tokens") + 1)
    least = counts.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "same")
    marked = counts.join(least, F.col("digest").eqNullSafe(F.col("same")), "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    return [
        (1, counts.select(none.alias("before"), old.alias("after"))),
        (2, marked.filter("copy").select(old.alias("before"), none.alias("after"))),
        (3, marked.filter("not copy and lang = 'fr'").select(old.alias("before"), new.alias("after"))),
    ]


def maintained(counts: DataFrame, first: str, second: str, path: str) -> DataFrame:
    """The totals after each batch of the corpus' life was committed, and then committed again."""
    store = Rollup(counts.sparkSession, path)
    for _ in range(2):
        for batch, changes in history(counts, first, second):
            store.commit(batch, changes)
    return store.totals()
