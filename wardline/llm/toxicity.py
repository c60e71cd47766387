"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts of the labelled table are taken as unlabelled, their labels unread.
The risk of a linear classifier is estimated from both with the class prior: the part that unlabelled texts
contribute as negatives is corrected for the positives among them and, where it falls below zero, driven back up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.text import fold, pieces, plain_words, table

#: Bounds of the labelled sample that the classifier is fitted on (each row's features are a few kilobytes).
MAX_POSITIVES, MAX_UNLABELLED = 3_000, 8_000
FEATURES = 4_096
_STEMS = (4, 5, 6, 7)


def features(text: str | None) -> tuple[Counter, int]:
    """Occurrences of whole words and of word beginnings of 4 to 7 bytes (marked by a star), and the number of words."""
    words = plain_words(text)
    found = Counter(words)
    for word, n in list(found.items()):
        for size in _STEMS:
            if len(word) > size:
                found[word[:size] + b"*"] += n
    return found, len(words)


def density(times, words):
    """What a feature counts: its share of the words, in per mille, damped."""
    return np.log1p(1000.0 * times / words)


class _Hits(dict):
    """Per word, the chosen features it counts for (mostly none); emptied when full and without long words, so that
    what stays in a worker process is some 20 MB at most."""

    LIMIT, LONGEST = 1 << 17, 64

    def __init__(self, chosen: dict[bytes, float]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        names = [word, *(word[:size] + b"*" for size in _STEMS if len(word) > size)]
        hits = tuple(x for x in names if x in self.chosen)
        if len(word) <= self.LONGEST:
            self[word] = hits
        return hits


class Classifier:
    """Weights by feature and a bias; `score` is the probability of the positive class."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias, self._hits = weights, bias, _Hits(weights)

    def __reduce__(self):
        return Classifier, (self.weights, self.bias)

    def score(self, text: str | None) -> float:
        words = plain_words(text)
        times: dict[bytes, int] = {}
        for word in words:
            for name in self._hits[word]:
                times[name] = times.get(name, 0) + 1
        margin = self.bias + sum(self.weights[x] * float(density(n, len(words))) for x, n in sorted(times.items()))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))


def _matrix(texts: list, index: dict[bytes, int]):
    """Rows, columns and values of the texts' chosen features."""
    rows, columns, values = [], [], []
    for row, text in enumerate(texts):
        found, words = features(text)
        for name in found.keys() & index.keys():
            rows.append(row), columns.append(index[name]), values.append(density(found[name], words))
    return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values)


def choose(positives: list, unlabelled: list, count: int = FEATURES) -> list[bytes]:
    """The features whose document frequencies differ most between both samples, by a two-sample z score."""
    seen = []
    for texts in (positives, unlabelled):
        frequency = Counter()
        for text in texts:
            frequency.update(features(text)[0].keys())
        seen.append(frequency)
    p, u = seen
    names = sorted(name for name in p.keys() | u.keys() if p[name] + u[name] >= 5)
    if not names:
        return []
    a = np.array([p[x] for x in names]) / max(1, len(positives))
    b = np.array([u[x] for x in names]) / max(1, len(unlabelled))
    both = (a * len(positives) + b * len(unlabelled)) / (len(positives) + len(unlabelled))
    z = np.abs(a - b) / np.sqrt(both * (1 - both) + 1e-9)
    return [names[i] for i in np.argsort(-z, kind="stable")[:count]]


def fit(positives: list, unlabelled: list, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Classifier:
    """Full-batch Adam on the non-negative risk with the logistic loss; deterministic.

    Without positives or unlabelled texts every score is the prior.
    """
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    if not positives or not unlabelled:
        return Classifier({}, float(np.log(prior / (1 - prior))))
    names = choose(positives, unlabelled)
    index = {name: i for i, name in enumerate(names)}
    sides = [(len(t), *_matrix(t, index)) for t in (positives, unlabelled)]
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def margins(side):
        n, r, c, v = side
        return np.bincount(r, v * theta[c], n) + theta[-1]

    def pulled(side, slope):
        n, r, c, v = side
        return np.append(np.bincount(c, v * slope[r], len(names)), slope.sum()) / n

    for step in range(1, steps + 1):
        p, u = (1 / (1 + np.exp(-np.clip(margins(s), -30, 30))) for s in sides)
        rest = -np.log(1 - u + 1e-12).mean() + prior * np.log(1 - p + 1e-12).mean()
        correction = pulled(sides[1], u) - prior * pulled(sides[0], p)
        slope = prior * pulled(sides[0], p - 1) + correction if rest >= 0 else -correction
        slope[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Classifier({name: float(w) for name, w in zip(names, theta[:-1], strict=True) if w}, float(theta[-1]))


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
) -> Classifier:
    """A classifier from the rows whose crc32(doc_id) mod 5 is not 0.

    The class prior is the share of toxic rows among all labelled rows of those folds. The texts are a sample bounded by
    `max_positives` and `max_unlabelled`: the rows whose ids hash lowest. A row is toxic if any label of its id says
    so; null labels, unknown ids and null ids teach nothing.
    """
    marks = (
        labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id) != 0))
        .groupBy(F.col(doc_id).cast("bigint").alias("id")).agg((F.max(toxic) == 1).alias("toxic"))
    )
    counted = marks.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
    order = F.xxhash64(F.lit(7), "id")
    taken = (
        marks.where("toxic").orderBy(order, "id").limit(max_positives).withColumn("side", F.lit(1))
        .unionByName(marks.orderBy(order, "id").limit(max_unlabelled).withColumn("side", F.lit(0)))
    )
    rows = (
        docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("body"))
        .join(F.broadcast(taken), "id").groupBy("id", "side").agg(F.min("body").alias("body"))
        .orderBy("side", "id").toLocalIterator(prefetchPartitions=True)
    )
    sides: tuple[list, list] = ([], [])
    for row in rows:
        sides[row["side"]].append(row["body"])
    return fit(sides[1], sides[0], (counted["p"] or 0) / max(1, counted["n"]))


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with a column of scores in 0..1, from the text alone; null and empty texts get the bias's score.

    A column of that name is replaced; every row is scored, repeated ones alike.
    """
    rows = docs.drop(out) if out != text else docs
    place = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            scores = [sent.value.score(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), out="score")
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
