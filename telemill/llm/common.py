"""What the training-data operators share: staging of intermediate tables, batch-wise text kernels, components.

Text kernels work on whole Arrow batches.  A word is identified by a 64-bit hash of its bytes, a run of
words by a 64-bit hash of its word hashes; two different ones agree with a probability of about 2**-64.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other byte belongs to a word.
WHITE = b" \t\n\x0b\x0c\r"
#: Rows and bytes in an Arrow batch: bound what a task and its Python worker hold where texts are long.
BATCH_ROWS, BATCH_BYTES = "512", "8m"


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


#: Folders of the scope that is open, if any, and those that lazy results may still read.
_OWNED: ContextVar[list[str] | None] = ContextVar("telemill_owned", default=None)
_KEPT: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the folders that are staged inside: its end removes them, and no others.

    To be put around work whose results are written inside too.
    """
    own: list[str] = []
    outer = _OWNED.set(own)
    try:
        yield
    finally:
        _OWNED.reset(outer)
        for path in own:
            removed(spark, path)


def owned(path: str) -> str:
    """A folder that goes with the open scope; without one it stays while the session lives, as lazy results read it."""
    own = _OWNED.get()
    (_KEPT if own is None else own).append(path)
    return path


@atexit.register
def _end() -> None:
    spark = SparkSession.getActiveSession()
    while spark is not None and _KEPT:
        removed(spark, _KEPT.pop())


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only on one machine (tests, a laptop) a session without it gets a temporary folder, kept for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.telemill.scratch", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="telemill-")
        spark.conf.set("spark.telemill.scratch", base)
    return f"{base.rstrip('/')}/telemill-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows, written to the shared folder and read again, and the folder's name."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    out, path = written(df)
    owned(path)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as a batch needs them."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            made = []
            for b in (self.base, self.inverse):
                a = np.full(size, b, dtype=np.uint64)
                a[0] = 1
                made.append(np.multiply.accumulate(a))
            self.up, self.down = made
        return self.up, self.down


_BYTES, _WORDS, _OTHER = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of values[start:end] for each pair, in time linear in the values."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a batch of texts: byte offsets, hashes and how many each text has."""

    def __init__(self, texts: pa.Array, separators: np.ndarray, recode: np.ndarray | None = None) -> None:
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.data = raw if recode is None else recode[raw]
        inside = ~separators[self.data]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[self.offsets] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before &= ~first[:-1]
            after &= ~first[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    @property
    def hashes(self) -> np.ndarray:
        return _ranges(_BYTE_CODES[self.data], self.starts, self.ends, _BYTES)

    def docs(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def separators(of: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(of)] = True
    return table


def runs_of(hashes: np.ndarray, counts: np.ndarray, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each `size` consecutive words that lie in one text, and the index of each run's first word."""
    n = len(hashes)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    starts = np.flatnonzero(left >= size)
    return _ranges(hashes, starts, starts + size, _OTHER if second else _WORDS), starts


def whole_hashes(hashes: np.ndarray, bounds: np.ndarray, second: bool = False) -> np.ndarray:
    """A hash of all words of each text."""
    return _ranges(hashes, bounds[:-1], bounds[1:], _OTHER if second else _WORDS)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words [start, end) for each pair."""
    return _ranges(hashes, starts, ends, _OTHER)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts hold about `most` bytes; a longer text is a piece of its own."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: counts[i] of the values for row i."""
    at = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, type=kind))


def labelled(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that it is connected to."""
    n = len(linked)
    linked = linked | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the component is its least node.

    Alternating large-star and small-star rounds.  Least neighbours are partial sums; where a round joins
    them back, the side of the least has one row for each node, so a node with very many neighbours is a
    skewed join that adaptive execution splits (or a broadcast, where the written sides are small).  Rounds
    grow with the logarithm of the longest path.  An edge from a node to itself, or with a null end, is left
    out; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = written(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        now, path = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        removed(spark, old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    owned(path)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
