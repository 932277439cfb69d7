"""Token-id files: each document's ids compressed alone with a zstandard dictionary that all share.

The dictionary is trained on the id arrays of a bounded sample of documents.  A file table has rows of
several megabytes: the frames of many documents one after another, and an index of their ids, offsets and
token counts beside the dictionary's hash, so that one short document is read without its neighbours.
Documents stand in ascending order of doc_id.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, slices, staged

TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), 2
#: The sample that the dictionary is trained on (documents, and ids of each), the dictionary's size, a file row's size.
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES, ROW_BYTES = 512, 4096, 64 << 10, 4 << 20
#: What a worker's cache of chunks holds at most, in bytes, and the longest chunk that it keeps.
CACHE_BYTES, CACHE_CHUNK, _ENTRY = 192 << 20, 64, 180
#: A row group of the files: a few rows, so that one of them is read without the others.
GROUP_BYTES = 8 << 20


class _Encoder:
    """Ids by white-space separated chunk: the tokenizer's rules never look across ASCII white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        # the tokenizer lowers case itself; to lower A-Z before makes more chunks equal (not near special tokens' marks)
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        missing = list(set().union(*chunks).difference(self.known))
        made = self.tokenizer.encode_batch_fast([c.decode() for c in missing], add_special_tokens=False) if missing else []
        new = dict(zip(missing, (np.array(e.ids, dtype=self.type).tobytes() for e in made)))
        long = {c: x for c, x in new.items() if len(c) > CACHE_CHUNK}  # of texts without spaces: used here, not kept
        self.known.update(new if not long else {c: x for c, x in new.items() if c not in long})
        self.held += _ENTRY * (len(new) - len(long))
        get, tail = self.known.__getitem__, np.array([end], dtype=self.type).tobytes()
        return [b"".join([*([long[x] if x in long else get(x) for x in c] if long else map(get, c)), tail]) for c in chunks]


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


@lru_cache(maxsize=4)
def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, path: str, end: int, sample: int = SAMPLE) -> bytes:
    """A dictionary from at most `sample` documents (the least by a hash of doc_id), `SAMPLE_IDS` ids of each."""
    ids = [r[0] for r in docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            made = e.encode([(t or "").encode() for t in b.column("text").to_pylist()], end)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m[: SAMPLE_IDS * e.type.itemsize] for m in made], pa.binary())], ["doc_id", "ids"])

    some = docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids)).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")
    samples = [bytes(r[0]) for r in some.orderBy("doc_id").limit(sample).select("ids").collect()]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 64:
        return b"".join(samples)[-DICTIONARY_BYTES:]  # too little to train on: the arrays themselves
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Writes every row's whole text as ids, the end id after it; null is an empty text.

    Three tables at `path`: files, dictionary, and index (doc_id, part and row of its file row, first byte,
    bytes; sorted by doc_id).  Rows with a null doc_id come first; rows of one doc_id stand
    together; an empty table gives empty files.  Other columns are not read.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, end)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw))], "hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)  # at most DICTIONARY_BYTES
    kind = dict(docs.dtypes)["doc_id"]

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, z = encoder(tokenizer), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared.value), write_checksum=False)
        for b in slices(batches, "text"):
            made = e.encode([(t or "").encode() for t in b.column("text").to_pylist()], end)
            n = pa.array([len(m) // e.type.itemsize for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array([z.compress(m) for m in made], pa.binary())], ["doc_id", "n", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, width = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer).type.itemsize
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            sizes = [len(f) for f in frames]
            columns = {
                "part": pa.array([part], pa.int32()), "row": pa.array([number], pa.int32()), "before": pa.array([before], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64()),
                "width": pa.array([width], pa.int32()), "dictionary": pa.array([name]), "doc_ids": pa.array([ids], pa.list_(kinds)),
                "n": pa.array([counts], pa.list_(pa.int64())), "offsets": pa.array([np.cumsum([0, *sizes]).tolist()], pa.list_(pa.int64())),
                "data": pa.array([b"".join(frames)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for b in batches:
            kinds = b.schema.field("doc_id").type
            for i, n, f in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("frame").to_pylist()):
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
                if size >= ROW_BYTES:
                    yield row()
                    number, before = number + 1, before + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield row()

    frames = staged(docs.select("doc_id", "text").mapInArrow(compress, f"doc_id {kind}, n long, frame binary"))
    # the frames are written first: dealing by range looks at its input twice
    ordered = frames.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "frame")
    files = f"part int, row int, before long, tokens long, width int, dictionary string, doc_ids array<{kind}>, n array<long>, offsets array<long>, data binary"
    ordered.mapInArrow(pack, files).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/files")
    made = spark.read.parquet(f"{path}/files").select("part", "row", F.posexplode("doc_ids").alias("at", "doc_id"), "offsets")
    first, last = F.get("offsets", F.col("at")), F.get("offsets", F.col("at") + 1)
    # the files stand in order of doc_id already, and so do their rows in here
    made.select("doc_id", "part", "row", first.alias("first"), (last - first).alias("bytes")).write.parquet(f"{path}/index")


def _dictionary_at(spark: SparkSession, path: str) -> tuple[str, bytes]:
    name, raw = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(raw)
    if hashlib.sha256(raw).hexdigest() != name:
        raise ValueError(f"the dictionary at {path} is not the one of its hash")
    return name, raw


def _ids(data: bytes, width: int, z: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(z.decompress(data), dtype=f"<u{width}").astype("<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    name, raw = _dictionary_at(spark, path)
    shared = spark.sparkContext.broadcast((name, raw))
    files = spark.read.parquet(f"{path}/files")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # one row for each task that wrote: their number is the table's partitions, not its documents
    total = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    total = total.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw = shared.value
        z = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for b in batches:
            for at in range(b.num_rows):
                part, before, width, used, counts, offsets = (b.column(c)[at].as_py() for c in ("part", "before", "width", "dictionary", "n", "offsets"))
                if used != known:
                    raise ValueError(f"files of dictionary {used} beside dictionary {known}")
                data = b.column("data")[at].as_py()
                got = [_ids(data[lo:hi], width, z) for lo, hi in zip(offsets, offsets[1:])]
                n = np.array([len(x) for x in got], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[at].values, pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n), pa.array(n),
                     pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64())],
                    ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
                )

    rows = files.drop("tokens", "row").mapInArrow(run, f"doc_id {kind}, part int, before long, n_tokens long, ids_crc32 long")
    return rows.join(total, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """One document's ids; [] if it isn't there.

    Its entry is looked up in the index, whose row groups of other ids are skipped; of the files only the row
    group that holds its row is read, and only its frame is decompressed.
    """
    _, raw = _dictionary_at(spark, path)
    entry = spark.read.parquet(f"{path}/index").filter(F.col("doc_id") == doc_id).first()
    if entry is None:
        return []
    row = spark.read.parquet(f"{path}/files").filter((F.col("part") == entry.part) & (F.col("row") == entry.row))
    width, frame = row.select("width", F.substring(F.col("data"), F.lit(entry["first"] + 1).cast("int"), F.lit(entry.bytes).cast("int"))).first()
    return _ids(bytes(frame), width, zstandard.ZstdDecompressor(dict_data=_dictionary(raw))).tolist()


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """The documents written to the shared folder and read back."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
