"""Periodic runs: maximal stretches of words that repeat with a period, at every scale of the period.

A document is exploded into overlapping tiles for each octave of periods [B, 2B).  In a tile every B-th word is
a boundary.  A run of period q holds a boundary m with q words behind it, so it shows in the Z-values there: how
far the words from m and from m + q agree forwards, and how far those before them agree backwards.  Where both
together reach q, the tile has found a fragment of a run.  Periods under 8 are one scale whose neighbours are
compared word by word.  Fragments are shuffled by (document, period) and stitched where they overlap by a period.

The Z-values of all boundaries of a tile are taken at once: equal hashes of B / 2 words on one side of m and
m + q are necessary, and only where they agree the common length is searched, by halving.  A text of up to
TILED_BYTES is one tile of each octave and is solved where it is read; a longer one is dealt out, tile by tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _WORDS, WHITE, Words, lists, mix64, separators, signed, slices, staged

#: Periods below this are one scale; a run has at least LEAST words and two periods.
DIRECT, LEAST = 8, 12
#: Texts of more bytes are dealt out in tiles of about SEGMENT words (more where the period asks for it).
TILED_BYTES, SEGMENT = 8 << 20, 1 << 16

_SEPARATORS = separators(WHITE)
_FRAGMENT = "array<struct<start:bigint,`end`:bigint,period:bigint>>"


class _Tile:
    """Words as 64-bit values, of which runs never reach over `cuts` (one unique value each)."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        up, self.down = _WORDS.upto(len(values) + 1)
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def windows(self, size: int) -> np.ndarray:
        """A hash of each `size` consecutive values."""
        n = len(self.values) - size + 1
        return (self.total[size:] - self.total[:-size]) * self.down[:n]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many values from i on and from j on agree (or before them), at most `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            half = np.where(open_, (low + high + 1) // 2, low)
            a, b = (i - half, j - half) if back else (i, j)
            same = (self.total[a + half] - self.total[a]) * self.down[a] == (self.total[b + half] - self.total[b]) * self.down[b]
            low, high = np.where(same, half, low), np.where(open_ & ~same, half - 1, high)
        return low

    def short(self) -> list[np.ndarray]:
        """Fragments (start, end, period) of periods under DIRECT."""
        out = []
        for q in range(1, min(DIRECT, len(self.values))):
            same = np.zeros(len(self.values) - q + 2, dtype=bool)
            same[1:-1] = self.values[:-q] == self.values[q:]
            edges = np.flatnonzero(same[1:] != same[:-1])
            start, end = edges[::2], edges[1::2] + q
            long = end - start >= max(LEAST, 2 * q)
            out.append(np.stack([start[long], end[long], np.full(long.sum(), q)]))
        return out

    def octave(self, b: int, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Fragments of periods b to 2b - 1; first and last: bounds of the document of each value."""
        n, half = len(self.values), b // 2
        if n < 2 * b:
            return []
        rows = -(-n // b)
        # a window that would reach over an end equals no other
        ahead = mix64(np.arange(2 * rows * b, dtype=np.uint64))[: rows * b] | np.uint64(1)
        behind = ahead.copy()
        made = self.windows(half)
        ahead[: len(made)] = made
        behind[half : half + len(made)] = made[: max(0, rows * b - half)]
        near = np.zeros((rows - 1, b), dtype=bool)
        for side in (ahead.reshape(rows, b), behind.reshape(rows, b)):
            near |= side[1:] == side[:-1, :1]
        k, r = np.nonzero(near)
        m, q = k * b, b + r
        inside = m + q < last[m]
        m, q = m[inside], q[inside]
        right = self.common(m, m + q, last[m] - m - q, back=False)
        left = self.common(m, m + q, m - first[m], back=True)
        found = left + right >= q
        return [np.stack([m - left, m + q + right, q])[:, found]]


def _least(found: list[np.ndarray]) -> np.ndarray:
    """Of fragments of one place the one of the least period: the others' periods are its multiples."""
    if not found:
        return np.zeros((3, 0), dtype=np.int64)
    f = np.concatenate(found, axis=1).astype(np.int64)
    f = f[:, np.lexsort((f[2], f[1], f[0]))]
    new = np.ones(f.shape[1], dtype=bool)
    new[1:] = (f[0, 1:] != f[0, :-1]) | (f[1, 1:] != f[1, :-1])
    return f[:, new]


def _separated(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of several documents with a unique value after each, and the bounds of each value's document."""
    ends = np.cumsum(counts + 1)
    out = np.empty(len(values) + len(counts), dtype=np.uint64)
    own = np.ones(len(out), dtype=bool)
    own[ends - 1] = False
    out[own] = values
    out[ends - 1] = mix64(np.arange(1, len(counts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, np.repeat(ends - counts - 1, counts + 1), np.repeat(ends - 1, counts + 1)


def runs_of_documents(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of some documents: (start, end, period) by start, then period, and how many each document has."""
    kept, at, b = np.arange(len(counts)), counts, DIRECT
    out = []
    while len(kept):
        v, first, last = _separated(values, at)
        tile = _Tile(v)
        found = [*(tile.short() if b == DIRECT else []), *tile.octave(b, first, last)]
        for f in found:
            doc = np.searchsorted(np.cumsum(at + 1), f[0], side="right")
            out.append(np.vstack([f - np.vstack([first[f[0]], first[f[0]], np.zeros_like(f[0])]), kept[doc]]))
        b *= 2
        long = at >= 2 * b
        values, kept, at = values[np.repeat(long, at)], kept[long], at[long]
    if not out:
        return np.zeros((3, 0), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    f = np.concatenate(out, axis=1).astype(np.int64)
    f = f[:, np.lexsort((f[2], f[1], f[0], f[3]))]
    new = np.ones(f.shape[1], dtype=bool)
    new[1:] = (f[[0, 1, 3], 1:] != f[[0, 1, 3], :-1]).any(axis=0)
    f = f[:, new]
    return f[:3], np.bincount(f[3], minlength=len(counts))


def _structs(f: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    at = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, mask=np.append(null, False)), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in f], ["start", "end", "period"]))


def _solved(digest: bool, tiled_bytes: int):
    """Rows (key, doc_id, text) to (key, doc_id, n_words, runs, text, collapsed).

    text only where there are runs or they are still to be found in tiles (runs is null), collapsed only where not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            long = np.array([len(t.encode()) > tiled_bytes for t in texts], dtype=bool)
            w = Words(b.column("text"), _SEPARATORS)
            f, n = runs_of_documents(w.hashes[~np.repeat(long, w.counts)], w.counts[~long])
            every = np.zeros(len(texts), dtype=np.int64)
            every[~long] = n
            held = long | (every > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("doc_id"), pa.array(w.counts, pa.int64()), _structs(f, every, long), pa.array([t if k else None for k, t in zip(held, texts)], pa.string()),
                 pa.array([None if k else _made(t.encode().split(), digest) for k, t in zip(held, texts)], pa.string())],
                ["key", "doc_id", "n_words", "runs", "text", "collapsed"],
            )

    return run


def _made(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _tiles(segment: int):
    """Rows (key, text) to tiles (key, scale, at, words): every octave of the text in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column("text"), _SEPARATORS)
            values = w.hashes
            for i, key in enumerate(b.column("key").to_pylist()):
                v, scale = values[w.bounds[i] : w.bounds[i + 1]], DIRECT
                while scale == DIRECT or len(v) >= 2 * scale:
                    step = max(segment, 8 * scale)
                    for x in range(0, max(1, len(v)), step):
                        # from one period before its boundaries to two longest periods behind them
                        piece = v[max(0, x - scale) : x + step + 4 * scale]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key]), pa.array([scale], pa.int64()), pa.array([max(0, x - scale)], pa.int64()), lists(signed(piece), np.array([len(piece)]), pa.int64())], ["key", "scale", "at", "words"]
                        )
                    scale *= 2

    return run


def _tile_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            values = b.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            scale, at = b.column("scale")[i].as_py(), b.column("at")[i].as_py()
            v, first, last = _separated(values, np.array([len(values)]))
            tile = _Tile(v)
            f = _least([*(tile.short() if scale == DIRECT else []), *tile.octave(scale, first, last)])
            yield pa.RecordBatch.from_arrays([pa.array([b.column("key")[i].as_py()] * f.shape[1], pa.string()), *(pa.array(x, pa.int64()) for x in (f[0] + at, f[1] + at, f[2]))], ["key", "start", "end", "period"])


def _collapsed(digest: bool):
    """The words of a text that no run drops: all of a run but its first period go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs")):
                words = (text or "").encode().split()
                if runs.is_valid and len(runs):
                    start, period, length = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "period", "length"))
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, start + period, 1)
                    np.add.at(change, start + length, -1)
                    words = [x for x, gone in zip(words, np.cumsum(change[:-1]) > 0) if not gone]
                out.append(_made(words, digest))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_words", "runs")), pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def stitched(fragments: DataFrame) -> DataFrame:
    """(key, start, end, period) of whole runs, from fragments that overlap by a period where they are of one run.

    A place that is a run of several periods is one of the least of them.  The fragments of one (key, period) lie
    in one document, and each tile has merged its own.
    """
    before = W.partitionBy("key", "period").orderBy("start", "end")
    rows = fragments.distinct().withColumn("reached", F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.count_if(F.col("reached").isNull() | (F.col("start") > F.col("reached") - F.col("period"))).over(before.rowsBetween(W.unboundedPreceding, 0)))
    whole = rows.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST), 2 * F.col("period")))
    return whole.groupBy("key", "start", "end").agg(F.min("period").alias("period"))


def collapse(docs: DataFrame, digest: bool = False, tiled_bytes: int = TILED_BYTES, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_words, runs (start, period, length; by start, then period) and collapsed of every row of docs.

    collapsed is the text's words without the repetitions of any run, joined by one space, or with `digest` the
    lower-case hex sha256 of that.  A null text is an empty one: no words, no runs.  A row given twice comes
    twice.  Texts of any length are taken whole; a document's runs, fewer than its words, are one array.  Other
    columns are not read.  An empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    # equal rows have one key and equal runs
    rows = docs.select(F.concat(*[F.hex(F.xxhash64(F.lit(k), "doc_id", "text")) for k in (1, 2)]).alias("key"), "doc_id", "text")
    # one scan of the texts; those to be tiled, and those with runs, are carried on in the staged table
    solved = staged(rows.mapInArrow(_solved(digest, tiled_bytes), f"key string, doc_id {kind}, n_words bigint, runs {_FRAGMENT}, text string, collapsed string"))
    tiles = solved.filter("runs is null").select("key", "text").mapInArrow(_tiles(segment), "key string, scale bigint, at bigint, words array<bigint>").repartition("key", "scale", "at")
    found = solved.select("key", F.inline("runs")).unionByName(tiles.mapInArrow(_tile_fragments, "key string, start bigint, `end` bigint, period bigint"))
    run = F.struct("start", "period", (F.col("end") - F.col("start")).alias("length"))
    runs = stitched(found).groupBy("key").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    some = solved.filter("text is not null").select("key", "doc_id", "n_words", "text")
    named = "array<struct<start:bigint,period:bigint,length:bigint>>"
    done = some.join(runs, "key", "left").select("doc_id", "n_words", F.coalesce("runs", F.array().cast(named)).alias("runs"), "text")
    done = done.mapInArrow(_collapsed(digest), f"doc_id {kind}, n_words bigint, runs {named}, collapsed string")
    return solved.filter("text is null").select("doc_id", "n_words", F.array().cast(named).alias("runs"), "collapsed").unionByName(done)


def report(docs: DataFrame) -> DataFrame:
    """For each row: how many runs, the longest (of equal ones the first, then that of the least period), and digests."""
    out = collapse(docs, digest=True)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("longest"), lines.alias("lines"), "collapsed")
    text = F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise("")
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return out.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten (by a checksum of its id) repeats its words from a place on.

    A row without an id is left as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("bigint").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^ \t-\r]+)"), F.lit(1))).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("bigint"))
    again = F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(again, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))
