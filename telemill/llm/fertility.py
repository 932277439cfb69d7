"""Quality rule: tokeniser fertility of each document, judged by bands that its language's documents set.

A public vocabulary with byte fallback splits every word; a document's measures are characters per token,
the share of byte-fallback tokens and the entropy of its tokens.  Text that is not prose of its language
(shouting, symbol noise, tables, repetition) splits into other pieces than its language does and leaves
the band.  Entropy depends on length, so bands are set per language and per octave of tokens; an octave
with few texts takes its language's neighbouring ones in, and copies weigh as one text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Words, mix64, runs_of, separators, signed, slices, staged

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
_SPACE, _NOT_LINE = separators(WHITE), separators(b"\n")
_SYMBOL = separators(b"#*$%&|<>")
#: What a worker's cache of words holds at most, in bytes, and the longest word that it keeps.
CACHE_BYTES, CACHE_WORD, _ENTRY = 96 << 20, 64, 230
#: Distinct texts that set a band, at least; a language that has fewer sets its bands by all it has.
SUPPORT = 20


class _Pieces:
    """Piece ids by word, made at the first use; emptied when full, so its memory is bounded."""

    def __init__(self, model: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text's words, as 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        missing = list(set().union(*texts).difference(self.known))
        made = self.model.encode([w.decode("utf-8", "replace") for w in missing], num_threads=1) if missing else []
        new = dict(zip(missing, (struct.pack(f"{len(x)}i", *x) for x in made)))
        long = {w: x for w, x in new.items() if len(w) > CACHE_WORD}  # of texts without spaces: used here, not kept
        self.known.update(new if not long else {w: x for w, x in new.items() if w not in long})
        self.held += _ENTRY * (len(new) - len(long))
        get = self.known.__getitem__
        return [b"".join([long[w] if w in long else get(w) for w in words] if long else map(get, words)) for words in texts]


@lru_cache(maxsize=2)
def _pieces(model: str) -> _Pieces:
    return _Pieces(model)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _tagged(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ mix64(docs.astype(np.uint64)))


def _twice(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key: is it found twice or more in its text."""
    tagged = _tagged(docs, keys)
    run = np.sort(tagged)
    again = np.unique(run[1:][run[1:] == run[:-1]])
    if not len(again):
        return np.zeros(len(keys), dtype=bool)
    return again[np.minimum(np.searchsorted(again, tagged), len(again) - 1)] == tagged


def _later(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key: is it equal to an earlier one of its text."""
    tagged = _tagged(docs, keys)
    later = np.ones(len(keys), dtype=bool)
    later[np.unique(tagged, return_index=True)[1]] = False
    return later


def _entropies(docs: np.ndarray, ids: np.ndarray, totals: np.ndarray) -> np.ndarray:
    run = np.sort(docs << np.int64(31) | ids)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(run)))
    weighted = np.bincount(run[first] >> np.int64(31), weights=n * np.log2(n), minlength=len(totals))
    some = np.maximum(totals, 1)
    return np.where(totals > 0, np.log2(some) - weighted / some, 0.0)


def _sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the least hash of its five-word runs (0 without one): equal for copies and mostly for near copies."""
    grams, _ = runs_of(hashes, counts, 5)
    n = np.maximum(counts - 4, 0)
    out = np.zeros(len(counts), dtype=np.uint64)
    if len(grams):
        out[n > 0] = np.minimum.reduceat(grams, (np.cumsum(n) - n)[n > 0])
    return signed(out)


def measure_batch(texts: pa.Array, model: str) -> dict[str, pa.Array]:
    """The columns of MEASURES and the sketch for a batch of texts; null counts as empty."""
    words = Words(texts, _SPACE)
    n, docs, hashes = words.counts, words.docs(), words.hashes
    # a code point begins at every byte that is not a continuation
    points = _per_text(((words.data & 0xC0) != 0x80) & ~_SPACE[words.data], words.offsets)
    grams, first = runs_of(hashes, n, 3)
    twice = _twice(docs[first], grams)
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[first[twice] + k] = True
    lines = Words(texts, _NOT_LINE)
    line_docs, inside = lines.docs(), np.concatenate([[0], np.cumsum(~_SPACE[lines.data])])
    full = inside[lines.ends] > inside[lines.starts]
    later = _later(line_docs[full], lines.hashes[full])
    pieces, buffer, at = _pieces(model), words.data.tobytes(), words.offsets.tolist()
    made = pieces.of([buffer[a:b].split() for a, b in zip(at, at[1:])])
    tokens = np.fromiter(map(len, made), np.int64, len(made)) // 4
    ids = np.frombuffer(b"".join(made), dtype=np.int32)
    token_bounds = np.concatenate([[0], np.cumsum(tokens)])
    fallback = _per_text(pieces.fallback[ids], token_bounds)
    token_docs = np.repeat(np.arange(len(n), dtype=np.int64), tokens)
    some = np.maximum(tokens, 1)
    return {
        "n_words": pa.array(n.astype(np.int64)),
        "word_chars": pa.array(points),
        "n_symbols": pa.array(_per_text(_SYMBOL[words.data], words.offsets)),
        "n_dup_lines": pa.array(np.bincount(line_docs[full], weights=later, minlength=len(n)).astype(np.int64)),
        "n_repeat_words": pa.array(_per_text(covered, words.bounds)),
        "n_tokens": pa.array(tokens),
        "chars_per_token": pa.array(points / some),
        "byte_share": pa.array(fallback / some),
        "entropy": pa.array(_entropies(token_docs, ids, tokens)),
        "sketch": pa.array(_sketches(hashes, n)),
    }


def measure(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, lang, MEASURES and sketch for every row; one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made = measure_batch(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *made.values()], ["doc_id", "lang", *made])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, {MEASURES}, sketch long")


def _octave() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def bands(measured: DataFrame, reach: float = 4.0, slack: tuple[float, float, float] = (0.35, 0.02, 0.5)) -> DataFrame:
    """Per language and octave of tokens the lowest and highest accepted value of each measure.

    A band runs `reach` half-ranges (quarter to three quarters of the distinct texts that pass the base rule)
    from the median, and at least `slack` (characters per token, byte share, bits): a language whose
    documents all agree does not turn on small differences.  Texts of one sketch in a cell weigh as one, so
    copies move no quartile.  A cell's band is set by the octaves of its language within the least distance
    that holds SUPPORT distinct texts, or by the whole language.  Quantiles merge across tasks.
    """
    names = ("chars_per_token", "byte_share", "entropy")
    values = F.struct(*names)
    good = measured.filter("not base_failed")
    # any one of the copies, told by no measure's size
    distinct = staged(good.groupBy("lang", "octave", "sketch").agg(F.min_by(values, F.xxhash64(*names)).alias("v")).select("lang", "octave", "v.*"))
    cells = distinct.groupBy("lang", "octave").agg(F.count("*").alias("n"))
    other = cells.select(F.col("lang").alias("o_lang"), F.col("octave").alias("o_octave"), F.col("n").alias("o_n"))
    far = F.abs(F.col("octave") - F.col("o_octave"))
    near = cells.join(other, F.col("lang").eqNullSafe(F.col("o_lang"))).withColumn("far", far)
    # o_n of all octaves nearer than this one: it is needed while they are too few
    nearer = Window.partitionBy("lang", "octave").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    pooled = near.withColumn("have", F.coalesce(F.sum("o_n").over(nearer), F.lit(0))).filter(F.col("have") < SUPPORT)
    pooled = pooled.select(F.col("lang").alias("p_lang"), F.col("octave").alias("cell"), F.col("o_octave"))
    texts = distinct.join(pooled, F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("octave") == F.col("o_octave")))
    quarters = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q_{c}") for c in names]
    table = texts.groupBy("lang", F.col("cell").alias("octave")).agg(*quarters)
    for c, least in zip(names, slack):
        q = F.col(f"q_{c}")
        wide = F.greatest(F.lit(reach) * (q[2] - q[0]) / 2, F.lit(least))
        table = table.withColumn(f"lo_{c}", q[1] - wide).withColumn(f"hi_{c}", q[1] + wide)
    return table.select("lang", "octave", *(f"{e}_{c}" for c in names for e in ("lo", "hi")))


def judge(docs: DataFrame, model: str = MODEL, reach: float = 4.0) -> DataFrame:
    """Each document's measures, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated three-word windows.  kept: the base
    rule holds and every measure lies in its language's band.  A null language is a language of its own;
    null and empty texts have no words and fail the base rule; an empty table gives no rows; other columns
    of the table are not read.  A row given twice is judged twice.  The bands table has one row for each
    language and octave (some dozens for each language), so it is joined by the optimizer's own choice.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = staged(measure(docs, model).withColumn("base_failed", base).withColumn("octave", _octave()))
    b = bands(measured, reach).withColumnsRenamed({"lang": "b_lang", "octave": "b_octave"})
    held = F.lit(True)
    for c in ("chars_per_token", "byte_share", "entropy"):
        held = held & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    out = measured.join(b, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("octave") == F.col("b_octave")), "left")
    return out.select(
        *measured.columns[:1], *[c.split()[0] for c in MEASURES.split(", ")], "base_failed",
        F.coalesce(~F.col("base_failed") & held, F.lit(False)).alias("kept"),
    )
