"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words and shapes of words, and pairs of either, hashed. Each is
scaled by its class log-count ratio; a linear model with hinge loss is fitted to the scaled
indicators by dual coordinate descent. A logistic curve over out-of-fold margins turns margins
into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, release_heaps, release_worker, require, valid_text

BITS = 20
#: Labelled rows the model is fitted to, about; drawn by a hash of the id.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
#: Words a task remembers, about 150 bytes each.
CACHE = 400_000


def shape(word: str) -> str:
    """A run of capitals is A, of other letters a, of digits 0; the rest stays."""
    letters = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", letters)


class Words(dict):
    """For a chunk between white space: its hashed word feature in the high, its shape in the low bits."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        code = (crc32(b"w" + text.lower().encode()) << 32) | crc32(shape(text).encode())
        if len(self) < CACHE:
            self[word] = code
        return code


def features(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    chunks = (text or "").encode("utf-8", "surrogatepass").split()
    if not chunks:
        return np.zeros(0, np.int32)
    codes = np.fromiter(map(words.__getitem__, chunks), np.uint64, len(chunks))
    shapes = codes & np.uint64(0xFFFFFFFF)
    names = codes >> np.uint64(32)
    pairs = shapes[:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    phrases = names[:-1] * np.uint64(0x165667B19E3779F9) + names[1:] * np.uint64(0x27D4EB2F165667C5)
    every = [
        np.unique(names) * np.uint64(0xFF51AFD7ED558CCD), np.unique(shapes) * np.uint64(0xD6E8FEB86659FD93),
        np.unique(pairs) * np.uint64(0x9FB21C651E98DF25), np.unique(phrases) * np.uint64(0x85EBCA77C2B2AE63),
    ]
    return np.unique((np.concatenate(every) >> np.uint64(64 - BITS)).astype(np.int32))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 3
) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + sum cost * hinge(y * w.x), where x has
    values[i] at each feature i of a row, and 1 at the end."""
    weights = np.zeros(len(values) + 1)
    alpha = np.zeros(len(rows))
    scaled = [values[r] for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in scaled])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            row, v = rows[i], scaled[i]
            gradient = y[i] * (float(weights[row] @ v) + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[row] += step * v
                weights[-1] += step
                moved = max(moved, abs(step) * norms[i] ** 0.5)
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(size, smooth), np.full(size, smooth)
    for row, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[row] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with Platt's softened targets."""
    pos = float((y > 0).sum())
    neg = len(y) - pos
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gradient = x.T @ (p - target)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


class Model:
    """weights: those of the features, with the ratios in them; pickled to the tasks."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def score(self, row: np.ndarray) -> float:
        margin = float(self.weights[row].sum()) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS, cost: float = 0.1, folds: int = 3) -> Model:
    """y: 1 or -1. With rows of one class only, every score is that class's share (0.5 for none)."""
    if not len(rows) or len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 0.5) / (len(y) + 1)
        return Model(np.zeros(size + 1), 1.0, float(np.log(share / (1 - share))))

    def train(which: np.ndarray) -> np.ndarray:
        some, labels = [rows[i] for i in which], y[which]
        ratios = log_count_ratios(some, labels, size)
        # Both classes weigh the same in the loss; the logistic curve restores the prior.
        each = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels < 0).sum()))
        weights = dual_coordinate_descent(some, ratios, labels, cost * each * len(some))
        return np.concatenate([weights[:-1] * ratios, weights[-1:]])

    margins, at = np.zeros(len(rows)), np.arange(len(rows))
    for k in range(folds):
        weights = train(at[at % folds != k])
        margins[at % folds == k] = [float(weights[rows[i]].sum()) + weights[-1] for i in at[at % folds == k]]
    return Model(train(at), *logistic(margins, y))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    train_rows: int = TRAIN_ROWS, seed: int = 5,
) -> Model:
    """A model of `label` (0 or 1; others and null are left out) from about train_rows labelled rows
    of docs. The labels drawn are broadcast, which that bound allows; the driver gets their feature
    numbers, not the texts. An id with several labels has the one that most of them are (1, if as many);
    null ids match nothing."""
    require(docs, doc_id, text)
    require(labels, doc_id, label)
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    usable = usable.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    n = usable.count()
    drawn = usable.withColumn("_u", hash_fraction(F.col("_id"), seed)).where(F.col("_u") < train_rows / max(n, 1)).drop("_u")
    sample = docs.select(F.col(doc_id).alias("_id"), valid_text(F.col(text)).alias("_text")).join(F.broadcast(drawn), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = [features(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["id", "y", "row"])
        release_worker()

    found = sample.select(F.col("_id").cast("long"), "_text", "_y").mapInArrow(run, "id long, y int, row binary").orderBy("id", "y", "row").collect()
    rows = [np.frombuffer(bytes(r["row"]), np.int32) for r in found]
    return fit_rows(rows, np.array([1.0 if r["y"] else -1.0 for r in found]))


def score(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, score in (0, 1), predicted (1 if score >= threshold) for every row's whole text.

    Bytes that are no UTF-8 become U+FFFD. Null and empty texts have no features and get the score of the bias alone. Null ids and
    repeated rows are rows like others; other columns are not read. Empty input: no rows.
    """
    require(docs, doc_id, text)
    release_heaps(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shared.value
        for batch in batches:
            found = [model.score(features(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )
        release_worker()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), valid_text(F.col(text)).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
