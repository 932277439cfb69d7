"""Substring dedup: a count-min prefilter on windows of words, then exact grouping of what may repeat.

A window of 50 words is sketched by its minimizer: the least hash among the runs of 8 words inside it, which
depends on the window's words alone.  So the count of a minimizer is never below the count of any window
that has it, and neighbouring windows mostly share one.  Each partition sketches its texts' minimizers into
two rows of cells; sketches merge by addition; cells that count twice or more become a bitmap of fixed size.
The second pass keeps only windows whose cells are set in both rows, and so loses no repeated window.

Kept windows are grouped exactly by run: neighbouring windows that share a minimizer.  A run of words that
an earlier document has is repeated as a whole.  Where a minimizer occurs with different runs, their single
windows are grouped too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Words, lists, mix64, runs_of, separators, signed, slices, span_hashes, staged

WINDOW, GRAM = 50, 8
#: log2 of the sketch's cells in a row, and of the bitmap's bits in a row (8 MB each): both fixed.
CELL_BITS, MAP_BITS, ROWS = 32, 26, 2
_SPACE = separators(WHITE)
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BUCKET = 32768  # bits in one bitmap value of Spark's bitmap functions


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(words: Words, window: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows of one text that share a minimizer.

    doc and start (first word in the text), n windows, key (the minimizer), span (a hash of the run's words),
    and first: the index of the run's first window among all windows, whose hashes are `windows`.
    """
    hashes, counts = words.hashes, words.counts
    grams, gram_at = runs_of(hashes, counts, GRAM)
    windows, at = runs_of(hashes, counts, window, second=True)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return {k: none for k in ("doc", "start", "n", "first")} | {k: none.astype(np.uint64) for k in ("key", "span", "windows")}
    by_word = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    by_word[gram_at] = grams
    # past a text's last run of 8 words stand no grams, and windows reach no further than that
    key = _sliding_min(by_word, window - GRAM + 1)[at]
    doc = words.docs()[at]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(key)))
    begin = at[first]
    span = span_hashes(hashes, begin, begin + n - 1 + window)
    return {"doc": doc[first], "start": begin - words.bounds[doc[first]], "n": n, "first": first, "key": key[first], "span": span, "windows": windows}


def _cells(keys: np.ndarray, row: int) -> np.ndarray:
    return mix64(keys ^ _SALT[row]) >> np.uint64(64 - CELL_BITS)


def sketch(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The merged sketch: row, cell, n; each piece of a partition adds up its own cells first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 16 << 20):
            keys = runs(Words(b.column("text"), _SPACE), window)["key"]
            for row in range(ROWS):
                cells, n = np.unique(_cells(keys, row), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(cells) * ROWS + row), pa.array(n.astype(np.int32))], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n"))


def bitmaps(cells: DataFrame) -> list[np.ndarray]:
    """For each row of cells (cell * ROWS + row) their bitmap, folded to 2**MAP_BITS bits."""
    bit = F.expr(f"cell div {ROWS} % {1 << MAP_BITS}")
    rows = (
        cells.select((F.col("cell") % ROWS).alias("row"), bit.alias("bit"))
        .groupBy("row", F.expr(f"bit div {_BUCKET}").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.expr(f"bit % {_BUCKET}")).alias("bits"))
    )
    maps = [np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8) for _ in range(ROWS)]
    for row, bucket, bits in rows.toLocalIterator():
        maps[row][bucket * _BUCKET // 8 : (bucket + 1) * _BUCKET // 8] = np.frombuffer(bits, dtype=np.uint8)
    return maps


def _in(keys: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    held = np.ones(len(keys), dtype=bool)
    for row, m in enumerate(maps):
        bit = _cells(keys, row) & np.uint64((1 << MAP_BITS) - 1)
        held &= (m[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return held


def cells_of(keys: DataFrame) -> DataFrame:
    """The cells of keys, in both rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for row in range(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(signed(_cells(k, row)) * ROWS + row)], ["cell"])

    return keys.select("key").mapInArrow(run, "cell long")


def _own() -> Column:
    """Tells the rows of one id by their text."""
    return F.xxhash64("text")


def suspects(docs: DataFrame, maps: Broadcast, window: int = WINDOW, windows: bool = False) -> DataFrame:
    """The runs whose minimizer the bitmaps hold: key, span, doc_id, own (a hash of the row's text), start, n, and with `windows` their windows' hashes."""
    columns = f"key long, span long, doc_id {dict(docs.dtypes)['doc_id']}, own long, start int, n int" + ", windows array<long>" * windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            r = runs(Words(b.column("text"), _SPACE), window)
            held = _in(r["key"], maps.value)
            row = pa.array(r["doc"][held])
            out = {
                "key": pa.array(signed(r["key"][held])), "span": pa.array(signed(r["span"][held])), "doc_id": b.column("doc_id").take(row), "own": b.column("own").take(row),
                "start": pa.array(r["start"][held].astype(np.int32)), "n": pa.array(r["n"][held].astype(np.int32)),
            }
            if windows:
                out["windows"] = lists(signed(r["windows"][np.repeat(held, r["n"])]), r["n"][held], pa.int64())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.select("doc_id", "text", _own().alias("own")).filter("doc_id is not null").mapInArrow(run, columns)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, own and spans (array of start, stop in words) that windows of a smaller doc_id's text cover, for each id and text."""
    share = docs.sparkSession.sparkContext.broadcast  # bitmaps of a fixed size
    found = staged(suspects(docs, share(bitmaps(sketch(docs, window).filter("n >= 2"))), window))
    runs_seen = staged(found.groupBy("key", "span").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")))
    # whole runs that an earlier document has
    again = runs_seen.filter("latest > earliest").select("key", "span", "earliest")
    whole = found.join(again, ["key", "span"]).filter("doc_id > earliest")
    # single windows of each different run, in its earliest document, where a minimizer has several runs
    mixed = staged(runs_seen.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key"))
    opened = suspects(docs, share(bitmaps(cells_of(mixed))), window, windows=True)
    firsts = opened.join(runs_seen.join(mixed, "key").select("key", "span", "earliest"), ["key", "span"]).filter("doc_id = earliest")
    single = staged(firsts.select("key", "doc_id", "own", "start", F.posexplode("windows").alias("at", "w")))
    seen = single.groupBy("key", "w").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("latest > earliest")
    later = single.join(seen.drop("latest"), ["key", "w"]).filter("doc_id > earliest")
    spans = whole.select("doc_id", "own", "start", (F.col("start") + F.col("n") - 1 + window).alias("stop")).unionByName(
        later.select("doc_id", "own", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + window).alias("stop"))
    )
    return spans.groupBy("doc_id", "own").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row doc_id, n_words, n_removed and kept: the kept words, joined by single spaces.

    A word goes if a window that covers it also starts in a document with a smaller doc_id, judged on the
    input.  Null, empty and short texts lose nothing (null is kept as an empty text).  Rows with a null
    doc_id neither lose words nor count as earlier.  Rows of one doc_id do not remove each other's windows, and
    each loses what is repeated in its own text.  Of rows alike in windows and id all lose alike.  A very long text is taken whole, as a piece of
    its own.  An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.array([(s["start"], s["stop"]) for s in spans], dtype=np.int64)
                    at = np.minimum(at, len(words))
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 1], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    spans = repeated_spans(docs, window).withColumnsRenamed({"doc_id": "__id", "own": "__own"})
    joined = docs.select("doc_id", "text").join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (_own() == F.col("__own")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return without_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
