"""Quality by a sparse rule ensemble.

Statistics of a whole text feed shallow boosted trees; every path from a root to
a node is a conjunctive rule. A lasso logistic fit keeps few of the rules, and
these compile into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .words import words

STATISTICS = (
    "n_words", "mean_word", "distinct_share", "echo_share", "top_share", "upper_share", "digit_share",
    "mark_share", "shout_share", "bar_share", "odd_share", "line_words", "high_share",
)
UPPER, DIGITS, MARKS, SHOUT = bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"!"
ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in MARKS + SHOUT + b"|")


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS; a text without words has all zeros."""
    ws = words(text)
    n = len(ws)
    if not n:
        return (0.0,) * len(STATISTICS)
    raw = b" ".join(ws)
    size = len(raw)

    def share(delete: bytes) -> float:
        return (size - len(raw.translate(None, delete))) / size

    held = Counter(ws)
    echoes = sum(map(eq, ws, ws[1:]))
    high = (size - len(raw.decode("utf-8", "surrogatepass"))) / size
    return (
        float(n), (size - n + 1) / n, len(held) / n, echoes / n, max(held.values()) / n, share(UPPER), share(DIGITS),
        share(MARKS), share(SHOUT), share(b"|"), share(ODD), n / (text.count("\n") + 1), high,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and a double column for each statistic of ``docs(doc_id, text, ...)``."""
    bounded_batches(docs.sparkSession)

    def go(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            columns = np.array(rows, float).reshape(len(rows), len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in columns)], names=["doc_id", *STATISTICS])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(go, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: One condition: statistic index, whether the value must exceed the cut, the cut.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, cut in rule:
        ok &= (x[:, j] > cut) == above
    return ok


def _paths(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple[Condition, ...], found: list, fitted: np.ndarray, rate: float) -> None:
    """Grow one least-squares tree; every node's path is noted, leaves move ``fitted``."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            value, total = x[order, j], np.cumsum(residual[order])
            k = np.arange(1, len(order))
            ok = (value[1:] > value[:-1]) & (k >= least) & (len(order) - k >= least)
            if ok.any():
                gain = np.where(ok, total[:-1] ** 2 / k + (total[-1] - total[:-1]) ** 2 / (len(order) - k), -np.inf)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0] + 1e-12:
                    best = (gain[i], j, (value[i] + value[i + 1]) / 2)
    base = residual[rows].sum() ** 2 / len(rows)
    if best is None or best[0] <= base + 1e-9:
        fitted[_holds(x, path) if path else slice(None)] += rate * residual[rows].mean()
        return
    _, j, cut = best
    for above in (False, True):
        inside = rows[(x[rows, j] > cut) == above]
        at = (*path, (j, above, float(cut)))
        found.append(at)
        _paths(x, residual, inside, depth - 1, least, at, found, fitted, rate)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, lasso: float = 2e-4, steps: int = 2000, seed: int = 7) -> RuleModel:
    """Rules of boosted trees, weighted by lasso logistic regression (accelerated proximal gradient)."""
    if not len(y) or y.min() == y.max():
        return RuleModel(4.0 if len(y) and y[0] == 1 else (-4.0 if len(y) else 0.0), ())
    rng = np.random.default_rng(seed)
    fitted, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-fitted))
        rows = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        _paths(x, residual, rows, depth, least, (), found, fitted, rate * 4)
    columns, rules = {}, []
    for rule in found:
        held = _holds(x, rule)
        if 0 < held.sum() < len(y) and (key := held.tobytes()) not in columns:
            columns[key] = held
            rules.append(rule)
    r = np.column_stack([np.ones(len(y)), *(c.astype(float) for c in columns.values())])
    step = 4 * len(y) / np.linalg.norm(r, 2) ** 2
    w = ahead = np.zeros(r.shape[1])
    t = 1.0
    for _ in range(steps):
        gradient = r.T @ (1 / (1 + np.exp(-np.clip(r @ ahead, -40, 40))) - y) / len(y)
        new = ahead - step * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lasso, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = [(rule, float(v)) for rule, v in zip(rules, w[1:], strict=True) if abs(v) > 1e-6]
    return RuleModel(float(w[0]), tuple(kept))


def compile_score(model: RuleModel) -> Column:
    """The model as a column expression over the statistics' columns."""
    z = F.lit(model.intercept)
    for rule, weight in model.rules:
        held = None
        for j, above, cut in rule:
            one = F.col(STATISTICS[j]) > cut if above else F.col(STATISTICS[j]) <= cut
            held = one if held is None else held & one
        z = z + F.when(held, F.lit(weight)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, **options) -> RuleModel:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, those of the smallest id hashes.

    ``labels(doc_id, quality)``; rows with a null in either take no part, and a
    doc_id with several labels counts by its largest, one with several texts by
    the smallest of them. With one class only, or none, the model gives every text the same score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows, whatever the input's size: an id counts once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = texts.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = with_statistics(once).join(F.broadcast(picked), "doc_id").orderBy("doc_id", *STATISTICS).collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([float(r["quality"] > 0) for r in rows]), **options)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text.

    Null, empty and wordless texts have all statistics zero and the score of
    that. Repeated rows are answered each; a null doc_id stays null and counts
    as the id ''. Other columns are not read; an empty table gives an empty table.
    """
    scored = with_statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compile_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
