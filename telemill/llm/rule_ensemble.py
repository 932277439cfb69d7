"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

A forest of shallow trees is fitted to labelled documents; every path from a root to a node is a rule, a
conjunction of comparisons of statistics.  A lasso logistic regression over the rules leaves few of them
with a weight.  Those become one column expression, so that scoring is a projection inside the scan's stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Labelled rows that a fit takes at most (the least by a hash of doc_id), trees, their depth, the lasso's weight.
SAMPLE, N_TREES, TREE_DEPTH, LASSO, CUT = 20_000, 16, 3, 0.002, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; null counts as empty, and an empty text has zeros."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\t-\\r ]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    length = F.length(text)
    without = lambda pattern: length - F.length(F.regexp_replace(text, pattern, ""))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    n = F.size(words)
    return {
        "n_words": n.cast("double"),
        "word_length": share(length - n, n),
        "distinct_words": share(F.size(F.array_distinct(words)), F.least(n, F.lit(1000))),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n, F.size(lines)),
        "symbols": share(without("[#*$%&|<>]+"), length),
        "marks": share(without("[!?;:=_~]+"), length),
        "capitals": share(without("\\p{Lu}+"), length),
        "digits": share(without("[0-9]+"), length),
        "stops": share(without("[.]+"), n),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it at most, bound), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(s) <= b) if low else (F.col(s) > b) for s, low, b in self.terms])


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        total = reduce(lambda a, r: a + F.when(r.column(), r.weight).otherwise(0.0), self.rules, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(debug: str, names: list[str]) -> set[tuple[tuple[str, bool, float], ...]]:
    """Every root-to-node path of a printed tree; a statistic bounded twice on one side keeps the tighter bound."""
    out, path = set(), []
    for depth, feature, sign, bound in re.findall(r"^( +)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", debug, re.M):
        path = [x for x in path if x[0] < len(depth)] + [(len(depth), names[int(feature)], sign == "<=", float(bound))]
        tight: dict[tuple[str, bool], float] = {}
        for _, s, low, b in path:
            tight[s, low] = b if (s, low) not in tight else (min if low else max)(tight[s, low], b)
        out.add(tuple(sorted((s, low, b) for (s, low), b in tight.items())))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 7) -> Ensemble:
    """The ensemble of at most `sample` labelled documents.  Null labels and texts of no row are left out.

    A document labelled twice with one label counts once; with both it counts as both.  Without labels of
    both kinds the score is a constant: the label that there is, or one half.
    """
    some = labels.filter(f"doc_id is not null and {label} in (0, 1)").select("doc_id", F.col(label).cast("double").alias("__label")).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(sample)  # bounded, so broadcast
    made = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("__label", *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    table = staged(made)
    kinds = sorted(r[0] for r in table.select("__label").distinct().collect())
    if len(kinds) < 2:
        return Ensemble(20.0 * (2 * kinds[0] - 1) if kinds else 0.0, ())
    names = [c for c in table.columns if c != "__label"]
    data = VectorAssembler(inputCols=names, outputCol="x").transform(table.coalesce(2).sortWithinPartitions(*names, "__label"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="__label", numTrees=N_TREES, maxDepth=TREE_DEPTH, maxBins=64, subsamplingRate=0.7, seed=seed).fit(data)
    paths = sorted(set().union(*(tree_rules(t.toDebugString, names) for t in forest.trees)))
    rules = [Rule(p) for p in paths]
    fired = table.coalesce(2).select("__label", F.array(*(r.column().cast("double") for r in rules)).alias("rules"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(featuresCol="x", labelCol="__label", regParam=LASSO, elasticNetParam=1.0, maxIter=60, standardization=False)
    data = fired.select("__label", array_to_vector("rules").alias("x")).cache()
    model = lasso.fit(data)
    data.unpersist()
    kept = tuple(Rule(p, float(w)) for p, w in zip(paths, model.coefficients.toArray()) if abs(w) > 1e-6)
    return Ensemble(float(model.intercept), kept)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the CRC of its id: never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (all columns), held_out and score; a projection over the texts."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    stats = F.struct(*(c.alias(k) for k, c in statistics(F.col("text")).items()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), stats.alias("stats"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.select("row", "held_out", "stats.*").select("row", "held_out", model.score().alias("score"))


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """All columns, with __held_out, __score and __predicted (columns of these names are replaced).

    Learns from labels of documents that are not held out.  Null and empty texts are scored by their zeros;
    rows given twice are scored twice; an empty table gives no rows; no column but text enters a score.
    """
    added = {"__held_out": F.col("held_out"), "__score": F.col("score"), "__predicted": (F.col("score") >= cut).cast("int")}
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return _scored(docs, labels).select(*kept, *(c.alias(k) for k, c in added.items()))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents of a score of at least the cut; all columns, whatever their names; an empty table gives no rows."""
    return _scored(docs, labels).filter(F.col("score") >= cut).select(*[F.col("row")[c].alias(c) for c in docs.columns])
