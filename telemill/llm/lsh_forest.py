"""N-gram Jaccard join over a MinHash LSH forest, verified exactly on word five-grams.

Each tree of the forest labels a document with its number and a path of DEPTH bytes, one from each of its
min-hashes.  In their sorted order the labels are a trie: documents that agree in a prefix stand together.
The last depth is the longest prefix at which a pair at the threshold itself is met with the target
probability.  Few documents that agree that far are compared at once, whatever longer prefixes they share.
Where many do, matching starts at whole labels and shortens the prefix by one byte at a time.  A document
stops shortening once the expected share of its links that were met reaches the target, counting one more
link, at the threshold, than were found; so members of large groups of near copies stop early.  Where all
members of a node have stopped, the node is not looked at.

Equal texts are folded into one class first.  Members of a node are compared by sketches: the label bytes
below the last depth, which had no part in the meeting.  What they bring together becomes a candidate group,
and groups are verified on their words.  Groups of any size are handled in blocks bounded by members and
bytes, and no list of pairs leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Words, connected_components, labelled, mix64, runs_of, separators, signed, slices, staged, whole_hashes

_SPACE = separators(WHITE)
SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 40, 10, 0.9999
#: The share of pairs at the threshold that a sketch may lose.
SKETCH_LOSS = 1e-6
#: Members and bytes of a block: what a task compares at once are two blocks.  A longer text is in a block with few others.
BLOCK, BLOCK_BYTES = 128, 1 << 20
#: Documents whose links are counted by brute force where the recall is measured.
SAMPLE = 256


def met(similarity: float, depth: int, trees: int) -> float:
    """The probability that two documents of a similarity share a prefix of some depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def sketched(similarity: float, size: int, least: int) -> float:
    """The probability that sketches of `size` bytes agree in at least `least` of them."""
    same = similarity + (1 - similarity) / 256
    return sum(comb(size, k) * same**k * (1 - same) ** (size - k) for k in range(least, size + 1))


def sketch_cut(threshold: float, size: int) -> int:
    """The most bytes that may be asked to agree with a loss of at most SKETCH_LOSS at the threshold."""
    cut = int(threshold * size)
    while sketched(threshold, size, cut) < 1 - SKETCH_LOSS:
        cut -= 1
    return cut


def last_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is met, and kept by its sketch, with the target recall."""
    while depth > 1 and met(threshold, depth, trees) * (1 - SKETCH_LOSS) < recall:
        depth -= 1
    return depth


def enough(threshold: float, depth: int, trees: int, recall: float) -> int:
    """How many links a document must have found at a depth to stop there: one more may be at the threshold itself."""
    missed = 1 - met(threshold, depth, trees)
    return max(int(np.ceil(missed / (1 - recall))) - 1, 0)


@lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    codes = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (codes[:n].astype(np.uint32) | np.uint32(1)), codes[n:].astype(np.uint32)


def shingle_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles and how many it has; a shorter text with words is one shingle."""
    hashes = words.hashes
    whole = (words.counts > 0) & (words.counts < size)
    grams, first = runs_of(hashes, words.counts, size)
    at = np.concatenate([first, words.bounds[:-1][whole]])
    codes = np.concatenate([grams, whole_hashes(hashes, words.bounds)[whole]])
    return codes[np.argsort(at, kind="stable")], np.where(whole, 1, np.maximum(words.counts - size + 1, 0))


def signature_batch(texts: pa.Array, depth: int, last: int, trees: int) -> dict[str, pa.Array]:
    """For each text two hashes of its words, its labels (trees of them on end) and its sketch; null without words."""
    words = Words(texts, _SPACE)
    codes, counts = shingle_runs(words, SHINGLE)
    full = counts > 0
    folded = (codes >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
    n = int(full.sum())
    a, b = _family(depth * trees)
    least = np.zeros((len(a), n), dtype=np.uint32)
    if n:
        # by runs of whole texts that fit a processor's cache
        cuts = [0, *(np.flatnonzero(np.diff(at // 100_000)) + 1).tolist(), n]
        ends = np.append(at[1:], len(folded))
        for lo, hi in zip(cuts, cuts[1:]):
            piece, starts = folded[at[lo] : ends[hi - 1]], at[lo:hi] - at[lo]
            for i in range(len(a)):
                least[i, lo:hi] = np.minimum.reduceat(piece * a[i] + b[i], starts)
    levels = mix64(least.T.astype(np.uint64)).astype(np.uint8).reshape(n, trees, depth)
    number = np.broadcast_to(np.arange(trees, dtype=np.uint8)[None, :, None], (n, trees, 1))
    labels = iter(np.concatenate([number, levels], axis=2).reshape(n, -1))
    sketch = iter(levels[:, :, last:].reshape(n, -1))
    hashes = words.hashes
    return {
        "f1": pa.array(signed(whole_hashes(hashes, words.bounds)), mask=~full),
        "f2": pa.array(signed(whole_hashes(hashes, words.bounds, True)), mask=~full),
        "labels": pa.array([next(labels).tobytes() if x else None for x in full], type=pa.binary()),
        "sketch": pa.array([next(sketch).tobytes() if x else None for x in full], type=pa.binary()),
    }


def signatures(docs: DataFrame, depth: int, last: int, trees: int) -> DataFrame:
    """doc_id, a hash h of the text, and its signature, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made = signature_batch(b.column("text"), depth, last, trees)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *made.values()], ["doc_id", "h", *made])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, f1 long, f2 long, labels binary, sketch binary")


Link = Callable[[list], np.ndarray]


def alike(size: int, cut: int) -> Link:
    """Which of some sketches agree in `cut` bytes."""

    def link(sketches: list[bytes]) -> np.ndarray:
        s = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), size)
        return np.stack([np.count_nonzero(s == row, axis=1) for row in s]) >= cut

    return link


def numbered_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as (text, shingle) numbers: words are numbered exactly, and so are their runs."""
    known: dict[bytes, int] = {}
    numbers = []
    for t in texts:
        w = t.split()
        # 0 fills a text of fewer words up to one shingle
        numbers.append(np.fromiter((known.setdefault(x, len(known) + 1) for x in w), np.int64, len(w)) if w else np.zeros(0, np.int64))
    numbers = [np.append(x, np.zeros(SHINGLE - len(x), np.int64)) if 0 < len(x) < SHINGLE else x for x in numbers]
    sizes = np.array([max(len(x) - SHINGLE + 1, 0) for x in numbers], dtype=np.int64)
    code, base = [np.concatenate([x[k : len(x) - SHINGLE + 1 + k] for x in numbers if len(x)] or [np.zeros(0, np.int64)]) for k in range(SHINGLE)], len(known) + 1
    run = code[0]
    for k, column in enumerate(code[1:], 2):
        run = run * base + column
        if base ** (k + 1) >= 1 << 62 or k == SHINGLE:  # one more word would not fit 63 bits: number the runs so far
            run = np.unique(run, return_inverse=True)[1].astype(np.int64)
            if k < SHINGLE and len(run) * base >= 1 << 62:
                raise OverflowError("a block of texts has too many words")
    text = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    span = int(run.max()) + 1 if len(run) else 1
    pairs = np.unique(text * span + run)
    return pairs // span, pairs % span


def similar(threshold: float) -> Link:
    """Which of some texts have a Jaccard similarity of their shingles at or above the threshold (none with itself)."""

    def link(texts: list[bytes]) -> np.ndarray:
        text, shingle = numbered_shingles(texts)
        sizes = np.bincount(text, minlength=len(texts))
        often = np.bincount(shingle) if len(shingle) else np.zeros(1, np.int64)
        kept = often[shingle] > 1  # a shingle of one text is in no intersection
        text, column = text[kept], (np.cumsum(often > 1) - 1)[shingle[kept]]
        order = np.argsort(column, kind="stable")
        text, column = text[order], column[order]
        common = np.zeros((len(texts), len(texts)), dtype=np.float64)
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            has = np.zeros((len(texts), width), dtype=np.float32)
            has[text[lo:hi], column[lo:hi] - k * width] = 1
            common += has @ has.T
        np.fill_diagonal(common, 0)
        union = sizes[:, None] + sizes[None, :] - common
        return (common > 0) & (common / np.maximum(union, 1) >= threshold)

    return link


def _judged(link: Link, star: bool):
    """Over rows of key, a and b (blocks of cid and value; b may be null): who is linked.

    A row for each linked member: key, its cid, the cid of the first that it is joined to and how many it is
    linked to.  With `star` a is one member, and each of b has a row, with no root where it is not linked to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                key, a, b = (batch.column(c)[at].as_py() for c in ("key", "a", "b"))
                both = a + (b or [])
                linked = link([m["value"] for m in both])
                np.fill_diagonal(linked, False)
                cids = np.array([m["cid"] for m in both], dtype=np.int64)
                if star:
                    # the key's least member may be in b as well
                    some = np.arange(1, len(both))
                    root, n = np.where(linked[0, 1:] | (cids[1:] == cids[0]), cids[0], -1), np.full(len(some), int(linked[0].sum()))
                else:
                    n = linked.sum(axis=1)
                    some = np.flatnonzero(n)
                    root, n = cids[labelled(linked)[some]], n[some]
                columns = [pa.array(np.full(len(some), key)), pa.array(cids[some]), pa.array(root, mask=root < 0), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "cid", "root", "n"])

    return run


_OUT = "key long, cid long, root long, n long"


def _together(df: DataFrame) -> DataFrame:
    """The same rows in at most four partitions a core, merged where they are: a small round costs no task, file and Python call for each shuffle partition."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def _large(members: DataFrame) -> DataFrame:
    """key, nb and hub (its least member) of the keys that need several blocks."""
    sums = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("cid").alias("hub"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    # staged: the optimizer knows its size, and broadcasts it only where it is small
    return staged(_together(sums.filter("n > 1").select("key", parts.alias("nb"), "hub").filter("nb > 1")))


def _blocks(members: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of keys of one block (key, a), and those of large keys (key, nb, hub, block, members)."""
    tagged = members.join(large, "key", "left")
    item = F.struct("cid", "value")
    one = tagged.filter("nb is null").groupBy("key").agg(F.collect_list(item).alias("a")).filter("size(a) > 1")
    dealt = tagged.filter("nb is not null").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    return one, dealt.groupBy("key", "nb", "hub", "block").agg(F.collect_list(item).alias("members"))


def spanning(members: DataFrame, link: Link) -> DataFrame:
    """cid, root (itself, too) and n: edges that span what is linked among the members (key, cid, size, value) of each key.

    The members of a small key are all compared.  Those of a large key are compared with its least member
    first, each block in a task of its own; only what is not linked to that one is compared with all others.
    So a group of m near copies costs about m comparisons, and no link between different parts is lost.
    """
    large = _large(members)
    one, many = _blocks(members, large)
    none = F.lit(None)
    alone = _together(one.withColumn("b", none.cast(one.schema["a"].dataType))).mapInArrow(_judged(link, False), _OUT)
    if large.isEmpty():
        return staged(alone.select("cid", "root", "n"))
    many = staged(_together(many))
    hubs = many.select("key", "nb", "hub", F.explode(F.filter("members", lambda m: m["cid"] == F.col("hub"))).alias("m"))
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.array("m").alias("a"))
    first = staged(_together(hubs.join(many.select("key", "block", F.col("members").alias("b")), ["key", "block"]).select("key", "a", "b")).mapInArrow(_judged(link, True), _OUT))
    rest = first.filter("root is null").select("key", "cid")
    found = [alone, first.filter("root is not null")]
    if not rest.isEmpty():
        over = members.join(rest, ["key", "cid"])
        wide = _large(over)
        _, lots = _blocks(over, wide)
        # a lone member too must still meet all others
        few = over.join(wide.select("key"), "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("cid", "value")).alias("a"))
        blocks = few.unionByName(lots.select("key", F.col("members").alias("a")))
        pairs = blocks.join(many.select("key", F.col("members").alias("b")), "key").select("key", "a", "b")
        found.append(_together(pairs).mapInArrow(_judged(link, False), _OUT))
    return staged(reduce(DataFrame.unionByName, found).select("cid", "root", "n"))


def candidate_groups(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """(node, component) of the classes (cid, labels, sketch) that the forest and their sketches bring together."""
    last = last_depth(threshold, trees, depth, recall)
    size = trees * (depth - last)
    link = alike(size, sketch_cut(threshold, size)) if size else lambda x: np.ones((len(x), len(x)), dtype=bool)
    labels = classes.select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("labels"), t * (depth + 1) + 1, F.lit(depth + 1)))).alias("label"))
    prefix = lambda d: F.substring("label", 1, d + 1).alias("key")
    nodes = labels.groupBy(prefix(last)).agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(labels.withColumn("key", prefix(last)).join(nodes, "key"))
    sketches = classes.select("cid", F.lit(size).cast("long").alias("size"), F.col("sketch").alias("value"))

    def few(rows: DataFrame) -> DataFrame:
        # the same few documents meet in many trees: once is enough
        ids = rows.groupBy("key").agg(F.array_sort(F.collect_list("cid")).alias("ids")).select("ids").distinct()
        return ids.select(F.xxhash64("ids").alias("key"), F.element_at("ids", 1).alias("least"), "ids")

    small = few(shared.filter(F.col("n") <= BLOCK)).select("key", F.explode("ids").alias("cid")).join(sketches, "cid")
    small = small.groupBy("key").agg(F.collect_list(F.struct("cid", "value")).alias("a"))
    edges = [small.withColumn("b", F.lit(None).cast(small.schema["a"].dataType)).mapInArrow(_judged(link, False), _OUT)]
    crowd = shared.filter(F.col("n") > BLOCK).select("label", "cid")
    seen = settled = None
    for d in range(depth, last - 1, -1) if not crowd.isEmpty() else ():
        rows = crowd.select(prefix(d), "cid")
        if settled is not None:
            rows = rows.join(settled.withColumn("old", F.lit(1)), "cid", "left")
        is_open = F.lit(True) if settled is None else F.col("old").isNull()
        nodes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(is_open).alias("n_open"), F.min("cid").alias("hub")).filter("n > 1 and n_open > 0").select("key", "n", "hub")
        meet = rows.select("key", "cid").join(nodes, "key")
        fresh = few(meet.filter(F.col("n") <= BLOCK))
        fresh = staged(_together(fresh if seen is None else fresh.join(seen, ["key", "least"], "left_anti")))
        seen = fresh.select("key", "least") if seen is None else seen.unionByName(fresh.select("key", "least"))
        # large nodes of one least member, from all trees, are one: each of their members is compared with it once
        wide = meet.filter(F.col("n") > BLOCK).select(F.col("hub").alias("key"), "cid").distinct()
        members = fresh.select("key", F.explode("ids").alias("cid")).unionByName(wide)
        found = spanning(staged(_together(members.join(sketches, "cid").select("key", "cid", "size", "value"))), link)
        edges.append(found)
        if d > last:
            stops = found.groupBy("cid").agg(F.max("n").alias("n")).filter(F.col("n") >= enough(threshold, d, trees, recall)).select("cid")
            settled = staged(_together(stops if settled is None else settled.unionByName(stops).distinct()))
    return connected_components(reduce(DataFrame.unionByName, (e.select(F.col("cid").alias("a"), F.col("root").alias("b")) for e in edges)))


def _members(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """key (the candidate group), cid, size and value (the whole text) of every class in a group."""
    asked = classes.select("cid", "first_id", "h").join(groups.select(F.col("node").alias("cid"), F.col("component").alias("key")), "cid")
    # many texts and few members: the members are the built side, the texts stream past it unsorted
    texts = docs.select(F.col("doc_id").alias("first_id"), F.xxhash64("text").alias("h"), "text").join(asked.hint("shuffle_hash"), ["first_id", "h"])
    rows = texts.groupBy("key", "cid").agg(F.min("text").alias("text"))  # a row given twice is one
    return staged(rows.select("key", "cid", F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("value")))


def _counter(threshold: float):
    """Over rows of a and b (blocks of cid, weight and value; b may be null): each member's links and an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (batch.column(c)[at].as_py() for c in ("a", "b"))
                both = a + (b or [])
                linked = similar(threshold)([m["value"] for m in both])
                np.fill_diagonal(linked, False)
                if b:  # pairs inside a block are counted in its own row
                    linked[: len(a), : len(a)] = False
                    linked[len(a) :, len(a) :] = False
                links = linked @ np.array([m["weight"] for m in both], dtype=np.int64)
                some, root = np.flatnonzero(links), labelled(linked)
                cids = np.array([m["cid"] for m in both], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cids[some]), pa.array(cids[root[some]]), pa.array(links[some])], ["cid", "root", "links"])

    return run


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """cid, root and links: all pairs of each key's members (key, cid, size, value, weight) are compared, in blocks."""
    large = _large(members)
    tagged = members.join(large, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"), F.lit(0)))
    blocks = staged(tagged.groupBy("key", "nb", "block").agg(F.collect_list(F.struct("cid", "weight", "value")).alias("a")))
    left = blocks.filter("nb is not null").select("key", "block", "a")
    later = left.select("key", F.col("block").alias("later"), F.col("a").alias("b"))
    pairs = left.join(later, "key").filter("block < later").select("a", "b")
    none = F.lit(None).cast(blocks.schema["a"].dataType)
    every = blocks.filter("size(a) > 1").select("a", none.alias("b")).unionByName(pairs)
    # few rows with much work each: dealt evenly by number, not by size
    parts = 2 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(every.repartition(parts).mapInArrow(_counter(threshold), "cid long, root long, links long"))


def _classes(signed_docs: DataFrame) -> DataFrame:
    """The classes of equal words: cid, f1, f2, first_id (the least doc_id), h (of that row's text), copies, labels, sketch."""
    full = signed_docs.filter("doc_id is not null and f1 is not null")
    least = F.min(F.struct("doc_id", "h")).alias("least")
    rows = full.groupBy("f1", "f2").agg(least, F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    return staged(rows.select(F.monotonically_increasing_id().alias("cid"), "f1", "f2", F.col("least.doc_id").alias("first_id"), F.col("least.h").alias("h"), "copies", "labels", "sketch"))


def _joined(docs: DataFrame, threshold: float, trees: int, depth: int, recall: float, count: bool) -> DataFrame:
    """doc_id, h, class_id, copies and links (0 for all unless counted) of every row."""
    signed_docs = staged(signatures(docs, depth, last_depth(threshold, trees, depth, recall), trees))
    classes = _classes(signed_docs)
    members = _members(docs, classes, candidate_groups(classes, threshold, trees, depth, recall))
    if count:
        found = counted(members.join(classes.select("cid", F.col("copies").alias("weight")), "cid"), threshold)
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    else:
        found = spanning(members, similar(threshold))
        links = found.select("cid").distinct().withColumn("links", F.lit(0).cast("long"))
    components = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    # only what is linked or copied needs a row: the rest is its own class
    own = classes.select("cid", "f1", "f2", "first_id", "copies")
    told = own.join(components.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left").filter("copies > 1 or component is not null")
    told = told.withColumn("component", F.coalesce("component", "cid"))
    least = told.groupBy("component").agg(F.min("first_id").alias("class_id"))
    known = staged(told.join(least, "component").select("f1", "f2", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id"))
    out = signed_docs.select("doc_id", "h", "f1", "f2").join(known, ["f1", "f2"], "left")
    has = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "h",
        F.when(has, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(has, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("copies"),
        F.when(has, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("links"),
    )


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """For each row: doc_id, class_id, n_copies, n_links.

    n_links is the number of other documents whose set of word five-grams has a Jaccard similarity of at
    least the threshold, copies among them; class_id is the least doc_id that a chain of links reaches;
    n_copies counts the documents of the same words, the row's own among them.  Words are what ASCII white
    space separates; a document of one to four words is one shingle.  Null, empty and blank texts have no
    shingles: they are linked to nothing and are their own class.  A row with a null doc_id has no class
    (null) and no links.  Rows that repeat a doc_id are documents of their own, told by their texts.  A very
    long text is read whole, in a batch and a block with few others; it needs some 30 times its size in a task.
    doc_id is of any type that has an order.  An empty table gives no rows; other columns are not read.
    """
    out = _joined(docs, threshold, trees, depth, recall, True)
    return out.select("doc_id", "class_id", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))


def near_copy_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, h (xxhash64 of the text) and class_id of every row, as in jaccard_join but without counting links.

    A large group costs one comparison for each member that is linked to the group's first one.
    """
    return _joined(docs, threshold, TREES, DEPTH, RECALL, False).select("doc_id", "h", "class_id")


def keep_one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are first, by doc_id, of their group of linked documents; all columns.

    Rows with a null doc_id stay.  A row given twice stays twice.
    """
    later = near_copy_classes(docs, threshold).filter("class_id < doc_id").select(F.col("doc_id").alias("__later"), F.col("h").alias("__h")).distinct()
    same = (F.col("doc_id") == F.col("__later")) & (F.xxhash64("text") == F.col("__h"))
    return docs.join(later, same, "left_anti")


def measured_recall(docs: DataFrame, joined: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row: n_sample, n_true and n_found links of at most `sample` documents (the least by a hash of doc_id).

    n_true counts each one's links by brute force: its shingles against those of all rows.  n_found is what
    `joined`, a result of jaccard_join over unique ids, has for it, at most the true number.
    """
    asked = [(r.doc_id, r.text) for r in docs.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "text").limit(sample).collect()]
    codes, counts = shingle_runs(Words(pa.array([t for _, t in asked], pa.string()), _SPACE), SHINGLE)
    mine = np.unique(np.stack([np.repeat(np.arange(len(asked), dtype=np.uint64), counts), codes], axis=1), axis=0) if len(codes) else np.zeros((0, 2), np.uint64)
    mine = mine[np.argsort(mine[:, 1], kind="stable")]
    sizes = np.bincount(mine[:, 0].astype(np.int64), minlength=len(asked))
    shared = docs.sparkSession.sparkContext.broadcast((mine, sizes))  # the sample's shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes = shared.value
        for b in slices(batches, "text"):
            codes, counts = shingle_runs(Words(b.column("text"), _SPACE), SHINGLE)
            total = np.zeros(len(sizes), dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            for i in np.flatnonzero(counts).tolist():
                own = np.unique(codes[at[i] : at[i + 1]])
                lo, hi = np.searchsorted(rows[:, 1], own, "left"), np.searchsorted(rows[:, 1], own, "right")
                hit = np.concatenate([np.arange(x, y) for x, y in zip(lo[hi > lo], hi[hi > lo])]) if (hi > lo).any() else np.zeros(0, np.int64)
                common = np.bincount(rows[hit, 0].astype(np.int64), minlength=len(sizes))
                total += (common > 0) & (common / np.maximum(sizes + len(own) - common, 1) >= threshold)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    spark = docs.sparkSession
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(asked)], f"at long, doc_id {dict(docs.dtypes)['doc_id']}")
    true = docs.filter("doc_id is not null").select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    # a document with shingles found itself
    both = ids.join(true, "at").join(joined.select("doc_id", "n_links"), "doc_id").select("doc_id", (F.col("n") - 1).alias("n"), "n_links")
    return both.agg(F.lit(len(asked)).alias("n_sample"), F.sum("n").alias("n_true"), F.sum(F.least("n", "n_links")).alias("n_found"))
