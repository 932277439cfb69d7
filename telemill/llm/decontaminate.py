"""Benchmark decontamination over a distributed positional inverted index.

`index` stores the postings of every word of the corpus, whatever will be looked up: a segment is some
megabytes of neighbouring texts, and a row holds one term of one segment with all its places there.  `search`
turns test items into windows, orders each window's terms by their frequency in the whole corpus, and joins
windows to the segments that have their rarest term.  There the offset-adjusted places of the others are
intersected, rarest first.  Windows and postings meet by join and by segment: nothing passes through the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, lists, signed, slices, staged

WINDOW = 10
#: Words that a proximity match of the query may have between those of a window.
SLACK = 5
#: Bytes of texts in a segment (a longer text is one of its own), and of windows that meet a segment in one task: more windows take more tasks.
SEGMENT_BYTES, PASS_BYTES = 4 << 20, 32 << 20
#: Pairs of a window and a place that are compared at once.
PAIRS = 1 << 20
#: In place of a term: the row whose places are where the segment's texts begin.
BOUNDS = 0


def _separators() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[:0x80] = True
    table[0x30:0x3A] = False
    table[0x61:0x7B] = False
    return table


# A-Z become a-z; words are digits, a-z and everything past ASCII.
_SEPARATORS = _separators()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_of(texts: pa.Array) -> Words:
    return Words(texts, _SEPARATORS, _LOWER)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a segment, so that a term of many short texts is one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        own = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
        if held and size + own > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The positional index, to be written once and searched for any benchmark.

    Rows of two kinds.  Postings, where ord is null: segment, term (a word's hash), n and at, its n ascending
    places as 32-bit integers.  Texts, where it is not: segment, ord (from 0 in the segment), doc_id, two hashes
    of the text and n_words.  A place counts the segment's words with one empty place after each text.  Null,
    empty and wordless texts have no postings.  A term's places in a segment are bounded by the segment's size,
    so a frequent word is many rows; a very long text is one segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in slices(_gathered(batches, segment_bytes), "text", segment_bytes):
            words, rows = words_of(b.column("text")), b.num_rows
            if not rows:
                continue
            hashes = signed(words.hashes)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            n = np.concatenate([[rows], np.diff(np.append(new, len(ordered)))])
            at = np.concatenate([words.bounds[:-1] + np.arange(rows), order + words.docs()[order]]).astype("<i4")
            ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(at.tobytes())])
            none = lambda kind, k: pa.nulls(k, kind)
            ids = b.column("doc_id")
            postings = {
                "segment": pa.array(np.full(len(n), segment)), "ord": none(pa.int32(), len(n)), "term": pa.array(np.concatenate([[BOUNDS], ordered[new]])), "n": pa.array(n.astype(np.int32)), "at": places,
                "doc_id": none(ids.type, len(n)), "h1": none(pa.int64(), len(n)), "h2": none(pa.int64(), len(n)), "n_words": none(pa.int64(), len(n)),
            }
            texts = {
                "segment": pa.array(np.full(rows, segment)), "ord": pa.array(np.arange(rows, dtype=np.int32)), "term": none(pa.int64(), rows), "n": none(pa.int32(), rows), "at": none(pa.binary(), rows),
                "doc_id": ids, "h1": b.column("h1"), "h2": b.column("h2"), "n_words": pa.array(words.counts.astype(np.int64)),
            }
            for part in (postings, texts):
                yield pa.RecordBatch.from_arrays(list(part.values()), list(part))
            segment += 1

    kind = dict(docs.dtypes)["doc_id"]
    told = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    return told.mapInArrow(run, f"segment long, ord int, term long, n int, at binary, doc_id {kind}, h1 long, h2 long, n_words long")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, w and terms of every window of every item: w tells windows of equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = words_of(b.column("text"))
            own = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
            item = np.repeat(np.arange(b.num_rows), own)
            first = np.repeat(words.bounds[:-1], own) + np.arange(len(item)) - np.repeat(np.cumsum(own) - own, own)
            length = np.minimum(words.counts[item], size)
            flat = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(item)), lists(signed(words.hashes)[flat], length, pa.int64())], ["item_id", "terms"])

    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return items.mapInArrow(run, "item_id string, terms array<long>").distinct().withColumn("w", F.xxhash64("terms"))


class _Segment:
    """A segment's postings as one sorted array of (term's rank, place)."""

    def __init__(self, postings: pa.Table) -> None:
        terms = postings.column("term").to_numpy()
        order = np.argsort(terms)
        lists_of = pa.concat_arrays(postings.column("at").chunks).take(pa.array(order)).to_pylist()
        self.terms = terms[order]
        self.n = np.array([len(x) // 4 for x in lists_of], dtype=np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.at = np.frombuffer(b"".join(lists_of), dtype="<i4").astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.n)), self.n) << np.int64(32)) | self.at
        bounds = int(np.searchsorted(self.terms, BOUNDS))
        self.begins = self.at[self.first[bounds] : self.first[bounds] + self.n[bounds]]
        self.stops = np.append(self.begins[1:] - 1, np.int64(1) << 31)

    def text(self, places: np.ndarray) -> np.ndarray:
        # texts without words begin where the next one does not: each has its own empty place
        return np.searchsorted(self.begins, places, side="right") - 1

    def least(self, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The key of each term's first posting from a place on: of a later term where it has none."""
        at = np.searchsorted(self.keys, (ranks << np.int64(32)) + places)
        return np.where(at < len(self.keys), self.keys[np.minimum(at, len(self.keys) - 1)], np.int64(1) << 62)

    def between(self, rank: int, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, [(rank << 32) + low, (rank << 32) + high + 1])
        return self.at[a:b]


def _stretches(at: list[tuple[int, int]], need: dict[int, int], most: int) -> Iterator[tuple[int, int]]:
    """(first, last) place of each least stretch of at most `most` words that has all needed terms, from (place, term) in order."""
    missing, have, lo = len(need), defaultdict(int), 0
    for p, t in at:
        have[t] += 1
        missing -= have[t] == need[t]
        while p - at[lo][0] >= most or have[at[lo][1]] > need[at[lo][1]]:
            missing += have[at[lo][1]] == need[at[lo][1]]
            have[at[lo][1]] -= 1
            lo += 1
        if not missing and have[t] == need[t]:  # without its last word it would lack one
            yield at[lo][0], p


class _Windows:
    """Windows whose terms a segment all has: ranks and offsets, rarest first, padded by -1."""

    def __init__(self, windows: pa.Table, segment: _Segment) -> None:
        terms, offsets = (pa.concat_arrays(windows.column(c).chunks) for c in ("terms", "offsets"))
        self.size = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, place = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, offsets))
        rank = np.minimum(np.searchsorted(segment.terms, flat), len(segment.terms) - 1)
        row = np.repeat(np.arange(len(self.size)), self.size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.rank = np.full((len(self.size), int(self.size.max(initial=1))), -1, dtype=np.int64)
        self.offset = np.zeros_like(self.rank)
        self.rank[row, column], self.offset[row, column] = rank, place
        absent = np.bincount(row, weights=segment.terms[rank] != flat, minlength=len(self.size)) > 0
        self.whole = np.flatnonzero(~absent)
        self.w = windows.column("w").to_numpy()

    def anchored(self, segment: _Segment) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place of its rarest term) for all places, in blocks."""
        n = segment.n[self.rank[self.whole, 0]]
        block = np.cumsum(n) // PAIRS
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
            own = np.repeat(self.whole[part], n[part])
            inside = np.arange(len(own)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            yield own, segment.at[segment.first[self.rank[own, 0]] + inside]

    def exact(self, segment: _Segment, own: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first places where all their words follow each other."""
        start = places - self.offset[own, 0]
        for k in range(1, self.rank.shape[1]):
            r, at = self.rank[own, k], start + self.offset[own, k]
            stays = (r < 0) | (segment.least(r, at) == (r << np.int64(32)) + at)
            own, start = own[stays], start[stays]
        return own, start

    def near(self, segment: _Segment, own: np.ndarray, places: np.ndarray, slack: int) -> Iterator[tuple[int, int, int]]:
        """(window, first, last place) of least stretches around places that have every term near enough."""
        text = segment.text(places)
        reach = self.size[own] + slack - 1
        low, high = np.maximum(places - reach, segment.begins[text]), np.minimum(places + reach, segment.stops[text])
        for k in range(1, self.rank.shape[1]):
            r = self.rank[own, k]
            stays = (r < 0) | (segment.least(r, low) <= (r << np.int64(32)) + high)
            own, low, high = own[stays], low[stays], high[stays]
        if not len(own):
            return
        # neighbourhoods of one window that overlap are searched once; those of two texts never do
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (low[1:] > high[:-1])])
        first = np.flatnonzero(new)
        for i, a, b in zip(own[first].tolist(), low[first].tolist(), high[np.append(first[1:], len(own)) - 1].tolist()):
            need: dict[int, int] = defaultdict(int)
            for r in self.rank[i, : self.size[i]].tolist():
                need[r] += 1
            at = sorted((p, r) for r in need for p in segment.between(r, a, b).tolist())
            for p, q in _stretches(at, need, int(self.size[i]) + slack):
                yield i, p, q


_FOUND = "segment long, ord int, w long, near boolean, start int, stop int"


def _matched(slack: int | None):
    """Windows against one segment's postings: a row of _FOUND for each occurrence."""

    def run(key: tuple, postings: pa.Table, windows: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, ...]] = []
        if windows.num_rows and postings.num_rows:
            segment = _Segment(postings)
            asked = _Windows(windows, segment)
            for own, places in asked.anchored(segment):
                hit, start = asked.exact(segment, own, places)
                parts.append((hit, start, start + asked.size[hit], np.zeros(len(hit), dtype=bool)))
                if slack is not None:
                    close = np.array(list(asked.near(segment, own, places, slack)), dtype=np.int64).reshape(-1, 3)
                    parts.append((close[:, 0], close[:, 1], close[:, 2] + 1, np.ones(len(close), dtype=bool)))
        if not sum(len(p[0]) for p in parts):
            return pa.table({k: pa.array([], t) for k, t in (("segment", pa.int64()), ("ord", pa.int32()), ("w", pa.int64()), ("near", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()))})
        own, start, stop, near = (np.concatenate(c) for c in zip(*parts))
        text = segment.text(start)
        begin = segment.begins[text]
        return pa.table({
            "segment": pa.array(np.full(len(own), key[0].as_py(), dtype=np.int64)), "ord": pa.array(text.astype(np.int32)), "w": pa.array(asked.w[own]), "near": pa.array(near),
            "start": pa.array((start - begin).astype(np.int32)), "stop": pa.array((stop - begin).astype(np.int32)),
        })

    return run


def _found(stored: DataFrame, benchmark: DataFrame, size: int, slack: int | None, pass_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of windows (_FOUND), and which items have which windows (item_id, w)."""
    given = staged(_windows(benchmark, size))
    windows = given.select("w", "terms").dropDuplicates(["w"])
    postings = stored.filter("ord is null")
    used = windows.select(F.explode("terms").alias("term")).distinct()
    often = postings.join(used, "term").groupBy("term").agg(F.sum("n").alias("often"))
    # a window with a term that the corpus lacks occurs nowhere
    placed = windows.select("w", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(often, "term")
    by_rarity = F.array_sort(F.collect_list(F.struct("often", "offset", "term")))
    ordered = placed.groupBy("w", "size").agg(by_rarity.alias("t")).filter(F.size("t") == F.col("size"))
    plan = staged(ordered.select("w", F.col("t")[0]["term"].alias("term"), F.col("t.term").alias("terms"), F.col("t.offset").alias("offsets")))
    weight = plan.agg(F.coalesce(F.sum(F.size("terms") * 12 + 32), F.lit(0))).first()[0]
    tasks = max(1, -(-int(weight) // pass_bytes))
    part = F.pmod("w", F.lit(tasks)).cast("int").alias("part")
    asked = postings.select("segment", "term").join(plan, "term").select(F.col("segment").alias("in_segment"), part, "w", "terms", "offsets")
    needed = plan.select(F.explode("terms").alias("term")).distinct().unionByName(stored.sparkSession.range(1).select(F.lit(BOUNDS).cast("long").alias("term")))
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))) if tasks > 1 else F.lit(0)
    lists_of = postings.select("segment", "term", "at").join(needed, "term", "left_semi").select("segment", every.alias("part"), "term", "at")
    met = lists_of.groupBy("segment", "part").cogroup(asked.groupBy("in_segment", "part"))
    return met.applyInArrow(_matched(slack), _FOUND), given.select("item_id", "w")


def _joined(found: DataFrame, owners: DataFrame) -> DataFrame:
    """segment, ord, near and spans: each item's occurrences in a text, joined where they touch."""
    own = ("segment", "ord", "near", "item_id")
    rows = found.join(owners, "w").select(*own, "start", "stop")
    before = Window.partitionBy(*own).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*own).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    apart = rows.withColumn("new", F.coalesce((F.col("start") > F.max("stop").over(before)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(upto))
    spans = apart.groupBy(*own, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("segment", "ord", "near").agg(F.array_sort(F.collect_list(F.struct("item_id", "start", "stop"))).alias("spans"))


def search(stored: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each text of a stored index doc_id, n_words, spans and near: arrays of (item_id as string, start, stop) in words, stop excluded.

    spans: where windows of `window` consecutive item words occur (of an item with fewer words: all of them),
    joined where they touch.  near: where a window's words stand within `slack` words more, in any order: each
    least stretch that has them all, joined likewise; empty without slack.  A-Z count as a-z; null, empty and
    wordless texts match nothing; an empty benchmark gives no spans; items given twice count as one; a null
    item_id is left out; rows of one doc_id are each judged by their own text.
    """
    texts = stored.filter("ord is not null").select("segment", "ord", "doc_id", "h1", "h2", "n_words")
    spans = _joined(*_found(stored, benchmark, window, slack, pass_bytes))
    one = lambda near: F.flatten(F.collect_list(F.when(F.col("near") == near, F.col("spans"))))
    both = spans.groupBy("segment", "ord").agg(one(False).alias("spans"), one(True).alias("near"))
    none = F.array().cast("array<struct<item_id:string,start:int,stop:int>>")
    out = texts.join(both, ["segment", "ord"], "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("near", none).alias("near"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words and spans of every row, as `search` gives them: exact ones, or with `slack` the near ones.  Other columns are not read."""
    got = search(staged(index(docs)), benchmark, window, slack, pass_bytes)
    return got.select("doc_id", "n_words", F.col("spans" if slack is None else "near").alias("spans"))


def report(matched: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, and further columns."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["stop"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"])).cast("long")).alias("n")
    )
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return matched.select(
        "doc_id",
        "n_words",
        F.aggregate(ordered, start, step, lambda a: a["n"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        *more,
    )


def near_items(matched: DataFrame) -> DataFrame:
    """The report with n_near_items, the items that have a near match (an exact one is near too)."""
    items = F.size(F.array_distinct(F.transform("near", lambda s: s["item_id"]))).cast("long").alias("n_near_items")
    return report(matched, items)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a test window; all columns.

    Every row is judged by its own text, also where doc_id is null or repeated.
    """
    stored = staged(index(docs))
    found, _ = _found(stored, benchmark, window, None, PASS_BYTES)
    texts = stored.filter("ord is not null").select("segment", "ord", F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    hit = texts.join(found.select("segment", "ord").distinct(), ["segment", "ord"]).select("__h1", "__h2").distinct()
    same = (F.xxhash64("text") == F.col("__h1")) & (F.xxhash64(F.lit(7), F.col("text")) == F.col("__h2"))
    return docs.join(staged(hit), same, "left_anti")
