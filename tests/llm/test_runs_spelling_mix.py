"""Spelling variants, periodic runs and the source mix against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import common, periodic_runs, queries, source_mix, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, key string, runs long, size string, `a b` string"


def frame(spark, texts, sources=("a",)):
    rows = [(i, t, "en", sources[k % len(sources)], 1, "r", "k", 7, "s", "z") for k, (i, t) in enumerate(texts)]
    return common.tuned(spark).createDataFrame(rows, SCHEMA).repartition(3)


# --- spelling variants


def brute_counts(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(n):
    holes = defaultdict(set)  # words with a letter taken out: two words one edit apart meet there
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
            near[w] |= {x for x in holes[cut] if len(x) == len(w) and x[:i] == w[:i] and x[i + 1 :] == w[i + 1 :]} - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op11_spelling_variants(spark, SF)
    assert got.columns == list(COLUMNS) and dict(got.dtypes)["n_near"] == dict(got.dtypes)["n"] == dict(got.dtypes)["form_n"] == "bigint"
    want = brute_variants(brute_counts(rows))
    assert sorted(map(tuple, got.collect())) == want and sum(w[1] is not None for w in want) > 10


@pytest.mark.parametrize("symbols", [2, 8, 26])
def test_spelling_variants_of_odd_words(spark, symbols):
    r = np.random.default_rng(5)
    words = {"".join(r.choice(list("abcdéÿ×"), int(r.integers(5, 9)))): int(r.integers(1, 40)) for _ in range(400)}
    words |= {"aaaaa": 50, "aaaaaa": 25, "aaaaaaa": 12, "baaaaa": 25, "x" * 3000: 9, "x" * 3001: 3, "x" * 1500 + "y" + "x" * 1500: 4, "abcde": 8, "abcdf": 8, "zbcde": 4, "ABCDE": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df, symbols).collect())) == brute_variants(words)


def test_spelling_chains_and_edges(spark):
    # three steps to the root; a null text and a null id
    chain = spark.createDataFrame([("abcdefgh", 3), ("abcdefg", 7), ("abcdef", 15), ("abcde", 31), ("vwxyz", 3)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(chain).collect()}
    assert got == {"abcdefgh": ("abcdefg", "abcde"), "abcdefg": ("abcdef", "abcde"), "abcdef": ("abcde", "abcde"), "abcde": (None, "abcde"), "vwxyz": (None, "vwxyz")}
    texts = [(1, "Straße STRASSE stra×e naïve,naïveĀnaïve"), (2, None), (3, ""), (None, "Naïve hello's Hello"), (4, "hello HELLO hellO " * 30), (4, "hello HELLO hellO " * 30), (5, "ñandú " * 300)]
    got = spelling.variants(spelling.vocabulary(spelling.with_slips(spelling.letter_runs(frame(spark, texts)))))
    assert sorted(map(tuple, got.collect())) == brute_variants(brute_counts(texts))
    assert spelling.variants(chain.limit(0)).count() == 0


# --- periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # the least period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_report(i, w):
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repeated(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    return w


def ordered(rows):
    return sorted(rows, key=repr)


def planted_texts():
    r = np.random.default_rng(11)
    word = lambda n, m=10**6: [f"w{x}" for x in r.integers(0, m, n)]
    some = word(700)
    fib = ["a"], ["a", "b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    texts = [
        " ".join(word(30) + word(40) * 3 + word(20)), " ".join(["the"] * 500), " ".join(some + some + some[:300]), " ".join(word(5) + word(6) * 2), " ".join(word(6) * 2), "x " * 11, "x " * 12,
        " ".join(word(2000, 3)), " ".join(fib[1]), " ".join((word(3) * 5 + word(1)) * 4), " ".join(word(127) * 2 + word(128) * 2 + word(129) * 2), " ".join(word(64) * 2 + word(64)), " ".join(word(1000, 2)),
        None, "", " \n\t", "one", "a b " * 300 + "a c " * 300, " ".join(word(9) * 40 + word(11) * 40), "é ü\x1cx " * 50,
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[0]), (0, texts[0]), (None, texts[2])]


@pytest.mark.parametrize("limits", [{}, {"tiled_bytes": -1, "segment": 16}, {"tiled_bytes": 500, "segment": 64}])
def test_periodic_runs(spark, limits):
    texts = planted_texts()
    got = periodic_runs.collapse(frame(spark, texts), **limits).collect()
    want = []
    for i, t in texts:
        w = WORD.findall(t or "")
        runs = sorted(brute_runs(w), key=lambda x: (x[0], x[2]))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert ordered((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got) == ordered(want)
    assert periodic_runs.collapse(frame(spark, texts).limit(0), **limits).count() == 0


def test_periodic_runs_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()]
    want = []
    for i, t in rows:
        w = repeated(i, t)
        if len(w) < 4000:  # brute force is quadratic in words
            want.append(brute_report(i, w))
    assert len(got) == len(rows) and ordered(g for g in got if g[0] in {x[0] for x in want}) == ordered(want)
    assert sum(x[1] > 0 for x in want) > 10
    odd = [(i, t) for i, t in planted_texts()] + [(k, "a b c d e f g h i j k l m n o p q r s t") for k in range(100, 160)]
    assert ordered(map(tuple, periodic_runs.report(periodic_runs.with_repeats(frame(spark, odd))).collect())) == ordered(brute_report(i, repeated(i, t)) for i, t in odd)


# --- source mix


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: per * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def mixed(spark, rows, block):
    df = common.tuned(spark).createDataFrame([(i, t, s, "z", 3) for i, t, s in rows], "doc_id long, text string, source string, sid string, size long").repartition(3)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    source = defaultdict(list)
    for i, t, s in rows:
        source[i, len(WORD.findall(t or ""))].append(s)
    got = source_mix.taken(df, block=block)
    return df, sizes, source, got, got.collect()


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_source_mix(spark, block):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), ["s1", "s2", "é", "z", None, "s10"][int(r.integers(0, 6)) if i % 3 else 0]) for i in range(300)]
    rows += [(1000, "w " * 5000, "long"), (1001, None, "none"), (1002, "", "s1"), (None, "a b", "s1"), (None, "a b", "s1"), (1003, "only", "tiny")]
    df, sizes, _, got, out = mixed(spark, rows, block)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(out) == len(rows)
    want = brute_targets(sizes)
    of = {i: s for i, _, s in rows}
    total = Counter()
    for x in out:
        s = of[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * (1 + want[s]) and 0 <= x.taken <= 2 * x["size"]
        total[s] += x.taken
    assert all(abs(total[s] - want[s]) <= 1 for s in want) and abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-3
    # whole passes: a source that is taken at least once is taken whole
    assert all(x.taken >= x["size"] for x in out if want[of[x.doc_id]] >= sizes[of[x.doc_id]])
    assert sorted(map(repr, out)) == sorted(map(repr, source_mix.taken(df.repartition(5), block=block).collect()))
    assert source_mix.taken(df.limit(0), block=block).count() == 0 and source_mix.taken(df.filter("source = 'none'"), block=block).collect()[0].taken == 0


def test_source_mix_order_is_even_and_whole(spark):
    rows = [(i, "w " * 40, "abc"[i % 3]) for i in range(600)]
    df, sizes, *_ = mixed(spark, rows, 32)
    pieces = source_mix.mixture(df, block=32).collect()
    slots = defaultdict(set)
    for p in pieces:
        slots[p.slot].add(p.source)
    order = ["".join(slots[k]) for k in range(len(slots))]
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(order)))
    share = {s: order.count(s) / len(order) for s in "abc"}
    # every stretch of the schedule has each source's share, but for a few slots
    for k in range(0, len(order) - 100, 37):
        assert all(abs(order[k : k + 100].count(s) - 100 * share[s]) <= 4 for s in "abc")
    # each word of a document is in the mix once a pass, and passes do not overlap
    words = Counter((p.doc_id, k) for p in pieces for k in range(p["first"], p["first"] + p.words))
    per_doc = Counter()
    for (i, k), n in words.items():
        assert 1 <= n <= 2 and 0 <= k < 40
        per_doc[i] += n
    assert per_doc == Counter({r.doc_id: r.taken for r in source_mix.taken(df, block=32).filter("taken > 0").collect()})
    # documents are shuffled: a source's first slots are not its first ids
    first = [p.doc_id for p in sorted(pieces, key=lambda p: (p.slot, p.at)) if p.source == "a"][:20]
    assert first != sorted(first)


def test_source_mix_query(spark):
    rows = [(r.doc_id, r.text, r.source) for r in queries.table(spark, SF, "documents").collect()]
    out = queries.op13_source_mix(spark, SF).collect()
    sizes, of = Counter(), {i: s for i, _, s in rows}
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, total = brute_targets(sizes), Counter()
    for x in out:
        total[of[x.doc_id]] += x.taken
    assert len(out) == len(rows) and all(abs(total[s] - want[s]) <= 1 for s in want)


def test_schedule_ranks_each_source_without_gaps(spark):
    sources = spark.createDataFrame([(0, 5000, 7000.0), (1, 10, 20.0), (2, 3, 0.5), (3, 100_000, 60_000.5), (4, 0, 0.0)], "sid long, source_size long, target double")
    got = source_mix.schedule(sources, 16).collect()
    took = Counter()
    for r in got:
        took[r.sid] += r.take
    assert took == {0: 7000, 1: 20, 3: 60_000} and sorted(r.slot for r in got) == list(range(len(got)))
    by_block = Counter((r.sid, r.block) for r in got)
    assert all(by_block[0, k] >= 1 for k in range(313)) and max(by_block.values()) == 2
    assert F.col("slot") is not None and source_mix.schedule(sources.limit(0)).count() == 0
