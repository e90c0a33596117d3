"""Toxicity as an ordered severity, by cumulative-link regression on sparse text features.

Features are a text's lower-cased words and their beginnings of four to seven
characters, so that a stem with an unseen ending still counts. All thresholds
share one weight vector: P(grade >= k) = 1 / (1 + exp(theta_k - w.x)), with
theta rising in k, and the expected severity is the sum of these over k.

The labels say only toxic or not. Grades above zero come from how densely a toxic
training text is set with the features that mark the toxic class: thirds of that
density are the grades 1, 2 and 3.

The model is fitted on the driver from a bounded sample of labelled rows; every
row is scored on executors from its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches

WORD = re.compile(r"\w+")
STEMS = range(4, 8)
#: Words of text per unit of length: counts are damped by 1 + words / LENGTH.
LENGTH = 200.0
REMEMBERED = 400_000


def features(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return [f"={word}", *(word[:k] for k in STEMS if len(word) >= k)]


@dataclass(frozen=True)
class SeverityModel:
    weights: dict[str, float]
    length_weight: float
    short_weight: float
    thresholds: tuple[float, ...]


def _plain(model: SeverityModel) -> tuple:
    """The model in built-in types only, which a broadcast can carry to any executor."""
    return model.weights, model.length_weight, model.short_weight, model.thresholds


class _WordWeights(dict):
    """A word's summed feature weights, worked out when first asked for."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        get = self.weights.get
        total = self[word] = sum(get(f, 0.0) for f in features(word))
        return total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    def __init__(self, model: SeverityModel):
        self.model, self.memo = model, _WordWeights(model.weights)

    def latent(self, text: str | None) -> float:
        words = WORD.findall(text.lower()) if text else []
        n = len(words) / LENGTH
        total = sum(map(self.memo.__getitem__, words))
        return (total + n * self.model.length_weight + self.model.short_weight) / (1 + n)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and the chance of grade 1 or more."""
        z = np.array([self.latent(t) for t in texts])
        above = _sigmoid(z[:, None] - np.array(self.model.thresholds)[None, :])
        return above.sum(axis=1), above[:, 0]


# -- fitting --------------------------------------------------------------------


def fit(names: list[str], strength: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, natural: float, grades: int = 3, ridge: float = 3e-4, steps: int = 400) -> SeverityModel:
    """Fit to counts ``value`` of feature ``column`` in text ``row``.

    ``strength`` is each feature's z score for the toxic class, ``natural`` the
    toxic share of all labelled rows, to which the classes are reweighted.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return SeverityModel({}, 0.0, 0.0, tuple(30.0 + k for k in range(grades)) if not n1 else tuple(-30.0 + k for k in range(grades)))
    size = sizes / LENGTH
    damp = 1 + size
    density = np.bincount(row, value * (strength > 4)[column], minlength=len(toxic)) / np.maximum(sizes, 1)
    cuts = np.quantile(density[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, density, "right"), 0)
    weight = np.where(toxic, natural / n1, (1 - natural) / n0)
    x = value / damp[row]
    d = len(names)
    # Parameters: feature weights, length and shortness weights, the first threshold, logs of the steps between thresholds.
    p = np.zeros(d + 2 + grades)
    p[d + 2] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(len(toxic))
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate(([p[d + 2]], np.exp(p[d + 3 :]))))
        z = np.bincount(row, x * p[column], minlength=len(toxic)) + (size * p[d] + p[d + 1]) / damp
        above = np.column_stack([np.ones(len(toxic)), _sigmoid(z[:, None] - theta[None, :]), np.zeros(len(toxic))])
        slope = above * (1 - above)
        chance = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
        up, down = -weight * slope[at, grade] / chance, weight * slope[at, grade + 1] / chance
        dz = up + down
        dtheta = np.array([-(up[grade == k].sum() + down[grade == k - 1].sum()) for k in range(1, grades + 1)])
        g = np.empty_like(p)
        g[:d] = np.bincount(column, x * dz[row], minlength=d) + ridge * p[:d]
        g[d], g[d + 1] = (dz * size / damp).sum(), (dz / damp).sum()
        tail = np.cumsum(dtheta[::-1])[::-1]
        g[d + 2], g[d + 3 :] = tail[0], tail[1:] * np.exp(p[d + 3 :])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = np.cumsum(np.concatenate(([p[d + 2]], np.exp(p[d + 3 :]))))
    return SeverityModel({f: float(p[j]) for j, f in enumerate(names)}, float(p[d]), float(p[d + 1]), tuple(theta.tolist()))


def _bag(text: str | None) -> tuple[int, Counter]:
    words = WORD.findall(text.lower()) if text else []
    bag = Counter()
    for w, c in Counter(words).items():
        for f in features(w):
            bag[f] += c
    return len(words), bag


def _names(batches):
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            names = list(_bag(text)[1])
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(names), pa.bool_()), pa.array(names, pa.string())], names=["toxic", "name"])


def _counter(vocabulary: dict[str, int]):
    def count(batches):
        for batch in batches:
            sizes, columns, values = [], [], []
            for text in batch.column("text").to_pylist():
                size, bag = _bag(text)
                held = [(vocabulary[f], c) for f, c in bag.items() if f in vocabulary]
                sizes.append(size), columns.append([j for j, _ in held]), values.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], names=["toxic", "size", "columns", "counts"])

    return count


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, most_features: int = 600, **options) -> SeverityModel:
    """Fit on at most ``sample`` labelled rows of each class, those of the smallest id hashes.

    Of the features in at least four sampled texts, the ``most_features`` that
    tell the classes apart best are used.

    ``labels(doc_id, toxic)``; rows with a null in either take no part, and a
    doc_id with several labels counts by its largest, one with several texts by
    the smallest of them. Without both classes the model says what it has seen: all clean (also when nothing is labelled), or all toxic.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = known.where("toxic").orderBy(order, "doc_id").limit(sample).unionByName(known.where("not toxic").orderBy(order, "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most two samples of rows, whatever the input's size: an id counts once.
    once = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    taken = Scratch(docs.sparkSession, "toxicity").save(once.select("toxic", "text").repartition(16), "sample")
    held = {r["toxic"]: r["n"] for r in taken.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = held.get(True, 0), held.get(False, 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    rest_a, rest_b = n1 - F.col("a") + 0.5, n0 - F.col("b") + 0.5
    odds = F.log(a / rest_a) - F.log(b / rest_b)
    counted = taken.mapInArrow(_names, "toxic boolean, name string").groupBy("name").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).where("a + b >= 4")
    best = counted.select("name", (odds / F.sqrt(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)).alias("z")).orderBy(F.desc(F.abs("z")), "name").limit(most_features).collect()
    names = [r["name"] for r in best]
    rows = taken.mapInArrow(_counter({f: j for j, f in enumerate(names)}), "toxic boolean, size long, columns array<int>, counts array<int>").collect()
    row = np.repeat(np.arange(len(rows)), [len(r["columns"]) for r in rows]) if rows else np.empty(0, np.int64)
    column = np.array([j for r in rows for j in r["columns"]], np.int64)
    value = np.array([c for r in rows for c in r["counts"]], float)
    natural = total.get(True, 0) / max(1, sum(total.values()))
    return fit(names, np.array([r["z"] for r in best]), row, column, value, np.array([r["size"] for r in rows], float), np.array([r["toxic"] for r in rows], bool), natural, **options)


def score(docs: DataFrame, model: SeverityModel, threshold: float = 0.5) -> DataFrame:
    """``doc_id, severity, probability, toxic`` of every row, from its whole text.

    ``severity`` is the expected grade (0 to 3), ``probability`` that of grade 1
    or more, ``toxic`` whether it reaches ``threshold``. Null, empty and wordless
    texts are never toxic: severity and probability 0. Repeated rows are answered
    each; other columns are not read; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))  # a few thousand weights

    def go(batches):
        scorer = Scorer(SeverityModel(*shared.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            severity, chance = scorer.score(texts)
            blank = np.array([t is None or not WORD.search(t) for t in texts], bool)
            severity, chance = np.where(blank, 0.0, severity), np.where(blank, 0.0, chance)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(chance), pa.array(chance >= threshold)], names=["doc_id", "severity", "probability", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(go, "doc_id long, severity double, probability double, toxic boolean")


def without_toxic(docs: DataFrame, model: SeverityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs(text, ...)``, all columns, whose text is not toxic."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))

    def go(batches):
        scorer = Scorer(SeverityModel(*shared.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            _, chance = scorer.score(texts)
            keep = [t is None or not WORD.search(t) or c < threshold for t, c in zip(texts, chance.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(go, docs.schema)
