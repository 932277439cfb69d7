"""Spelling variants: words one edit apart, found through a reduced alphabet, and the form that each belongs to.

Letters are hashed to SYMBOLS symbols.  Two words one edit apart have reduced words that are equal or one edit
apart, so the whole one-edit neighbourhood of each reduced word is generated, as 64-bit hashes that follow from
prefix sums, and joined with the reduced words of the vocabulary.  The join's condition compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Powers, mix64, signed, staged

#: Symbols that letters are hashed to: more give fewer words to compare and longer neighbourhoods.
SYMBOLS = 8
#: A word's least length and number; a form is at least so many times as frequent.
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: Neighbours in one Arrow batch; log2 of the bits that tell, before the shuffle, which reduced words there are (8 MB).
BATCH, MAP_BITS = 1 << 18, 26

LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = _Powers(0x9FB21C651E98DF25)


def letter_runs(docs: DataFrame) -> DataFrame:
    """doc_id and each maximal run of letters, A-Z made lower-case; a null text has none."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), F.lit(1))).alias("run")
    # most words have no capital: only the others are rewritten
    return docs.select("doc_id", run).select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))


def with_slips(runs: DataFrame, one_in: int = 97) -> DataFrame:
    """The runs as `word`, where one in so many (by a checksum of id and run) has lost a letter; a null id is an empty one."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    rows = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many letters and occurrences; counted by partial sums."""
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _flat(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of each letter of each word, lengths, each letter's number in its word, and a code for each symbol."""
    text = words.to_pylist()
    letters = np.frombuffer("".join(text).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
    symbol = (mix64(letters) % np.uint64(symbols)).astype(np.int64)
    codes = mix64(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return symbol, n, np.arange(len(letters)) - np.repeat(np.cumsum(n) - n, n), codes


def _key(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix64(h + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _before(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word the sums before each of its values and behind the last: n + 1 a word."""
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=run[1:])
    first = np.cumsum(n) - n
    at = np.arange(len(values) + len(n)) - np.repeat(np.arange(len(n)), n + 1)
    return run[at] - np.repeat(run[first], n + 1)


def own_keys(words: pa.Array, symbols: int) -> np.ndarray:
    """A hash of each word's reduced word."""
    symbol, n, at, codes = _flat(words, symbols)
    up, _ = _BASE.upto(int(n.max(initial=0)) + 2)
    sums = _before(codes[symbol] * up[at], n)
    return _key(sums[np.cumsum(n + 1) - 1], n)


def neighbour_keys(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all reduced words at most one edit from each word's, each once for a word, and the words' numbers."""
    symbol, n, at, codes = _flat(words, symbols)
    up, down = _BASE.upto(int(n.max(initial=0)) + 2)
    base, back = np.uint64(_BASE.base), np.uint64(_BASE.inverse)
    values = codes[symbol] * up[at]
    sums = _before(values, n)
    ends = np.cumsum(n + 1) - 1
    word, gap_word = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), n + 1)
    total, gap = sums[ends], np.arange(len(sums)) - np.repeat(ends - n, n + 1)
    here = np.arange(len(values)) + word  # the sum before each letter
    gone = sums[here] + (total[word] - sums[here + 1]) * back
    other = (total[word] - values)[:, None] + codes[None, :] * up[at][:, None]
    more = (sums + (total[gap_word] - sums) * base)[:, None] + codes[None, :] * up[gap][:, None]
    k = len(codes)
    parts = [(_key(gone, n[word] - 1), word), (_key(other, n[word][:, None]).ravel(), np.repeat(word, k)), (_key(more, n[gap_word][:, None] + 1).ravel(), np.repeat(gap_word, k))]
    key, of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], of[new]


def _pieces(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces whose neighbourhoods have about BATCH members; a longer word is a piece of its own."""
    for b in batches:
        size = np.cumsum([(2 * symbols + 1) * len(w) + symbols for w in b.column("word").to_pylist()]) // BATCH
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        yield from (b.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)


def _held(keys: DataFrame) -> np.ndarray:
    """A bit for each first MAP_BITS bits of a key: of a fixed size, so with very many words it rules out less and loses nothing."""
    bit = keys.select(F.shiftrightunsigned("key", 64 - MAP_BITS).alias("bit"))
    rows = bit.groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits"))
    bits = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    for bucket, part in rows.toLocalIterator():
        bits[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(part, dtype=np.uint8)
    return bits


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n) for each two words of (word, n) that are one inserted, deleted or replaced letter apart.

    Each pair comes once in either direction.  Work follows the vocabulary: (2 symbols + 1) neighbours for a letter,
    whatever its words' counts; those that are no word's reduced word are mostly dropped before the shuffle.  A very long word is generated by itself, in time linear in its letters.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, symbols):
            key, of = neighbour_keys(b.column("word"), symbols)
            bit = key >> np.uint64(64 - MAP_BITS)
            there = (known.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            key, of = key[there], of[there]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), b.column("word").take(pa.array(of))], ["key", "word"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, symbols):
            yield pa.RecordBatch.from_arrays([pa.array(signed(own_keys(b.column("word"), symbols))), b.column("word"), b.column("n")], ["key", "near", "near_n"])

    right = staged(words.mapInArrow(own, "key long, near string, near_n long"))
    known = words.sparkSession.sparkContext.broadcast(_held(right))
    left = words.select("word").mapInArrow(neighbours, "key long, word string")
    one = F.levenshtein(left["word"], right["near"], 1) == 1
    return left.join(right.hint("shuffle_hash"), (left["key"] == right["key"]) & one).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one, two steps at once in each round.

    A form is more frequent than its word, so chains are short and have no cycles.
    """
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = staged(now.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, symbols: int = SYMBOLS, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of (word, n).

    The form is the most frequent near word (of equals the first in code-point order) if it is at least `times`
    as frequent; else null, and the word is its own root.  Words are distinct; no words give no rows.
    """
    words = staged(words.select("word", "n"))
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    likely = F.col("best.n") <= -times * F.col("n")
    made = staged(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.n")).alias("form_n")))
    last = roots(made.filter("form is not null"))
    return made.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
