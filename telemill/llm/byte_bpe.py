"""Byte-level BPE through a sentencepiece model serialised from a rank vocabulary.

Every byte stands for one visible character, so that a token is a string; the token of rank r gets the
score -r, and the normaliser leaves text as it is.  Sentencepiece then merges the pair of the lowest rank
first, as rank-based byte-level BPE does.  Texts are split into pre-tokens first and each is encoded
alone.  A pre-token that is itself in the vocabulary is its own token.  Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: What a worker's cache of units holds at most, in bytes (a unit, its ids and what Python needs for them), and the
#: longest unit that it keeps: longer ones, as in texts without spaces, are encoded each time.
CACHE_BYTES, CACHE_UNIT, _ENTRY = 64 << 20, 64, 230

# Bytes that stand for themselves; the others take characters from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character of each byte 0..255."""
    rest = [b for b in range(256) if b not in set(_VISIBLE)]
    table = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file: the unknown piece first, then the tokens with score -rank.

    The format's fields: pieces 1 (text 1, score 2, kind 3; kind 1 normal, 2 unknown), trainer 2 (model
    kind 3: 2 is BPE), normaliser 3 (name 1, dummy prefix 3, extra spaces 4, escaped spaces 5).
    """
    of = byte_characters()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind))
    pieces = [piece("<unk>", 0.0, 2), *(piece("".join(of[b] for b in t), -float(r), 1) for r, t in enumerate(tokens))]
    trainer = _field(3, 2) + _field(4, len(pieces))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


_DOUBLE_SPACE = regex.compile(r"\s\s")
_UNIT = regex.compile(r"\s*\S+|\s+")


def _newer(pattern_class: str) -> set[str]:
    """The code points that this machine's pattern engine has in a class and the tokenizer's tables don't."""
    probe = tiktoken.Encoding("probe", pat_str=pattern_class, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    mine, out = regex.compile(pattern_class), set()
    for lo in range(0, 0x110000, 0x2000):  # in pieces: all at once would need 100 MB in each worker
        every = "".join(map(chr, (c for c in range(lo, lo + 0x2000) if not 0xD800 <= c < 0xE000)))
        if own := set(mine.findall(every)):
            out |= own - set(probe.decode_bytes(probe.encode_ordinary(every)).decode())
    return out


class Codec:
    """Encodes and decodes with one vocabulary; kept by each Python worker.

    A text falls into units, each some white space and the word after it.  No pre-token of the tokenizers'
    pattern reaches from a word into the white space behind it, so a unit's ids depend on the unit alone and
    are kept in a cache bounded in bytes.
    """

    def __init__(self, path: str) -> None:
        self.tokens = read_ranks(path)
        self.whole = {t: r for r, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.split = regex.compile(public_tokenizers.PATTERN)
        of = byte_characters()
        self.map = {b: of[b] for b in range(256)}
        inverse = {c: b for b, c in enumerate(of)}
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        bytes_of = [bytes(inverse[c] for c in self.model.id_to_piece(i + 1)) for i in range(len(self.tokens))]
        self.token_bytes = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.token_sizes = np.array([len(t) for t in bytes_of], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        # letters and digits of a later Unicode than the tokenizer's are neither to it, as unassigned ones
        self.newer = {ord(c): "\u0378" for c in _newer(r"\p{L}") | _newer(r"\p{N}")}
        self.oldest_newer = chr(min(self.newer, default=0x10FFFF))

    def pretokens(self, unit: str) -> list[str]:
        old = max(unit) < self.oldest_newer
        if old:  # the commonest units need no pattern: a word, or a word and a stop
            if unit.lstrip(" ").isalpha() and unit[:2] != "  ":
                return [unit]
            if unit[-1] in ",." and unit[:-1].lstrip(" ").isalpha() and unit[:2] != "  ":
                return [unit[:-1], unit[-1]]
            return self.split.findall(unit)
        plain = unit.translate(self.newer)
        return self.split.findall(unit) if plain == unit else [unit[m.start() : m.end()] for m in self.split.finditer(plain)]

    def piece_text(self, raw: bytes) -> str:
        if raw.isascii() and raw.lstrip(b" ").isalpha():
            return raw.decode().replace(" ", self.map[32])
        return raw.decode("latin-1").translate(self.map)

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units."""
        parts = {u: self.pretokens(u) for u in units}
        known: dict[str, bytes] = {}
        rest, texts = [], []
        for t in {t for p in parts.values() for t in p}:
            raw = t.encode()
            if (rank := self.whole.get(raw)) is not None:
                known[t] = rank.to_bytes(4, "little")
            else:
                rest.append(t)
                texts.append(self.piece_text(raw))
        made = self.model.encode(texts, num_threads=1) if rest else []
        flat = np.fromiter((i for ids in made for i in ids), dtype="<i4") - 1  # ranks follow the unknown piece
        data, at = flat.astype("<i4").tobytes(), 0
        for t, ids in zip(rest, made):
            known[t] = data[at : (at := at + 4 * len(ids))]
        return {u: known[p[0]] if len(p) == 1 else b"".join([known[t] for t in p]) for u, p in parts.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        units = []
        for text in texts:
            if _DOUBLE_SPACE.search(text):
                units.append(_UNIT.findall(text))
            elif text:
                first, *others = text.split(" ")
                units.append([*([first] if first else []), *[" " + x for x in others]])
            else:
                units.append([])
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        missing = set().union(*units).difference(self.cache)
        long = self._learn({u for u in missing if len(u) > CACHE_UNIT})
        made = self._learn(missing.difference(long))
        self.cache.update(made)
        self.cached += _ENTRY * len(made)
        get = self.cache.__getitem__
        if not long:
            return [b"".join(map(get, u)) for u in units]
        return [b"".join([long[x] if x in long else get(x) for x in u]) for u in units]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts of so many ids each, and each text's length in bytes."""
        size = self.token_sizes[ids]
        ends = np.cumsum(size)
        data = self.token_bytes[np.repeat(self.token_starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return data, np.diff(before)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(c: Codec, texts: pa.Array) -> pa.Array:
    made = c.encode([t or "" for t in texts.to_pylist()])
    return lists(np.frombuffer(b"".join(made), dtype="<i4"), np.fromiter(map(len, made), np.int64, len(made)) // 4, pa.int32())


def _decoded(c: Codec, ids: pa.Array) -> pa.Array:
    counts = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    data, sizes = c.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
    at = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text; null is the empty text, which has no ids.

    One pass, no shuffle.  Rows given twice come out twice; an empty table gives no rows; other columns are
    not read.  A very long text is encoded whole, in a batch of its own; its parts longer than CACHE_UNIT
    without white space are not cached.  Pre-tokens are those of public_tokenizers.PATTERN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _encoded(c, b.column("text"))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, ids and the decoded bytes of every row; null ids decode to nothing; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), _decoded(c, b.column("ids"))], ["doc_id", "ids", "decoded"])

    e = encoded.select("doc_id", "ids")
    return e.mapInArrow(run, f"doc_id {dict(e.dtypes)['doc_id']}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, ids and the bytes decoded from them: encode() and decode() in one Python worker for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "text", 2 << 20):
            ids = _encoded(c, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, _decoded(c, ids)], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, decoded again, digested."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
