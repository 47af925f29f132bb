"""Quality classifier: a sparse ensemble of rules, scored as one Spark column expression.

Statistics of each whole text are counted in one pass next to the text. A forest of shallow trees is grown on a bounded
sample of the labelled rows; every path from a root to a node is a rule, a conjunction of thresholds. Logistic regression
with an L1 penalty over the rules keeps a few of them. What scores the corpus is the weighted sum of these rules' conditions
under a sigmoid: built-in comparisons on the statistics, no model object.

The sample is of at most sample rows, those of least hash of their doc_id. If the training rows have one class or none,
every score is a constant, the smoothed share of label 1. Null texts are empty and are scored like any other. Labels that
are null are left out; a doc_id with several labels trains once for each. Rows that share a doc_id are scored each for
itself. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, saved

FEATURES = ("n_words", "mean_word", "word_spread", "distinct_share", "top_word_share", "upper_share", "digit_share", "mark_share", "symbol_share", "bang_share", "pipe_share", "line_share", "dup_line_share", "long_run_share", "stop_share", "other_share")
_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SYMBOL, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~+=_{}[]\\/")] = True
_STOP[list(b".,;:?'\"-()")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def measure(text: str | None) -> list[float]:
    """The statistics of one text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, n_bytes = data.split(), max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    letters = max(1, int(h[_UPPER].sum() + h[_LOWER].sum()))
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    run = sum(a == b for a, b in zip(words, words[1:], strict=False))
    inner = n_bytes - int(h[_SPACE].sum())
    share = lambda mask: float(h[mask].sum()) / max(1, inner)
    return [
        float(len(words)), float(sizes.mean()), float(sizes.std()), len(counts) / n, max(counts.values(), default=0) / n, float(h[_UPPER].sum()) / letters, share(_DIGIT), share(_STOP | _SYMBOL) + float(h[33]) / max(1, inner),
        share(_SYMBOL), float(h[33]) / max(1, inner), float(h[124]) / max(1, inner), len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), run / n, float(h[46]) / n, float(h[128:].sum()) / n_bytes,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measure(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def paths(debug: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Every path from a root to a node of printed trees, as (feature, "<=" or ">", threshold) conjunctions, each once."""
    out, stack = {}, []
    for line in debug.splitlines():
        if line.strip().startswith("Tree "):
            stack = []
        elif m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
            rule: dict[tuple[int, str], float] = {}
            for _, (f, op, t) in stack:
                rule[f, op] = t if (f, op) not in rule else (min if op == "<=" else max)(rule[f, op], t)
            out[tuple(sorted((f, op, t) for (f, op), t in rule.items()))] = None
    return sorted(out)


def condition(rule: tuple[tuple[int, str, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(FEATURES[f]) <= t if op == "<=" else F.col(FEATURES[f]) > t for f, op, t in rule])


class RuleEnsemble:
    """bias and (rule, weight) pairs; score() is the column expression over the statistics."""

    def __init__(self, bias: float, rules: list[tuple[tuple, float]]):
        self.bias, self.rules = bias, rules

    @classmethod
    def fit(cls, labelled: DataFrame, trees: int = 30, depth: int = 3, penalty: float = 0.003, sample: int = 20_000, seed: int = 11) -> RuleEnsemble:
        """labelled: doc_id, the statistics and y (0 or 1)."""
        some = saved(labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).coalesce(1), "labelled")
        n, ones = some.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if ones in (0, n):
            share = (ones + 1) / (n + 2)
            return cls(float(np.log(share / (1 - share))), [])
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(some).select("x", F.col("y").cast("double").alias("y"))
        forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5).fit(data)
        rules = paths(forest.toDebugString)
        if not rules:
            return cls(float(np.log(ones / (n - ones))), [])
        held = some.select("y", *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        data = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("x", F.col("y").cast("double").alias("y"))
        model = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-5).fit(data)
        return cls(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w])

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out rows are not read."""
    stats = saved(measured(docs), "statistics")
    own = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).where(~held_out(F.col("_id")))
    model = RuleEnsemble.fit(stats.join(own, stats["doc_id"] == own["_id"]).drop("_id"), **options)
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


