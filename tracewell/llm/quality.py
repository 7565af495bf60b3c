"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of text features. Weights are
learned from preference pairs (a document labelled 1 is preferred to one
labelled 0) by logistic loss on the difference of their features. The
threshold is the quantile of training strengths at the share of label 0; it is
mapped to a score of ``CUT``. How fast scores rise around it is fitted on the same
learned rows: one slope, by logistic loss of the labels.

Training takes at most ``max_per_class`` labelled rows of each class, whole texts;
their features are made on the executors and only numbers reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, logistic, sigmoid, text_slices, utf8
from .toxicity import label_rate, labelled_sample

CUT = 0.3
_CLASSES = [
    [*range(65, 91)], [*range(97, 123)], [*range(48, 58)], [*range(128, 256)], [32, 9, 11, 12, 13], [10],
    [ord(c) for c in ".,;:?'\"-"], [ord("!")], [ord(c) for c in "#$%&*@^~"], [ord(c) for c in "|<>{}[]()/\\=_+"],
]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[_bytes] = _k
N_FEATURES = len(_CLASSES) + 7


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (self.strength(x) - self.threshold) + math.log(CUT / (1 - CUT)))


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of byte classes, word and line shape, repetition (by deflate ratio and distinct words), length."""
    out = np.zeros((len(texts), N_FEATURES))
    for k, t in enumerate(texts):
        if not t:
            continue
        n = len(t)
        counts = np.bincount(_CLASS[np.frombuffer(t, dtype=np.uint8)], minlength=len(_CLASSES) + 1)
        words, lines = t.split(), t.split(b"\n")
        m = max(1, len(words))
        out[k] = [
            *(counts[: len(_CLASSES)] / n), n / m / 10, len(set(words)) / m, len(set(lines)) / len(lines),
            len(zlib.compress(t, 1)) / n, math.log1p(m), counts[0] / (1 + counts[0] + counts[1]), m / len(lines) / 100,
        ]
    return out


def _featured(rows: DataFrame) -> DataFrame:
    """rows (y, text): y and x, the features of the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                x = features(utf8(batch.column(1), i, j))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["y", "x"])

    return arrow_map(rows, made, "y int, x array<double>")


def fitted_slope(above: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The slope s > 0 of sigmoid(s * above + logit(CUT)) with the least weighted logistic loss, by bisection of its derivative in log s."""
    shift = math.log(CUT / (1 - CUT))
    low, high = -12.0, 12.0
    for _ in range(60):
        middle = (low + high) / 2
        if float((weight * (sigmoid(math.exp(middle) * above + shift) - y) * above).sum()) < 0:
            low = middle
        else:
            high = middle
    return min(math.exp(low), 20.0 / max(1e-9, float(np.abs(above).max())))  # no score is rounded to 0 or 1


def fit_quality(docs: DataFrame, labels: DataFrame, keep=None, max_per_class: int = 3000, pairs_per_doc: int = 8) -> QualityModel:
    """Learn from rows of labels (doc_id, quality) for which keep holds; without both classes every text scores just above CUT."""
    keep = F.lit(True) if keep is None else keep
    rows = _featured(labelled_sample(docs, labels, "quality", keep, max_per_class).select("y", "text")).collect()
    y, x = np.array([r.y for r in rows], dtype=int), np.array([r.x for r in rows]).reshape(-1, N_FEATURES)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -1.0, 1.0)
    order = np.lexsort((*x.T, y))  # the same pairs on every run
    y, x = y[order], x[order]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    few, many = sorted((good, bad), key=len)
    left = np.repeat(many, pairs_per_doc)
    right = rng.choice(few, len(left))
    winner, loser = (left, right) if many is good else (right, left)
    diff = z[winner] - z[loser]
    flip = np.where(np.arange(len(diff)) % 2, 1.0, -1.0)[:, None]  # both outcomes, so the loss has no constant answer
    weights = logistic(diff * flip, (flip[:, 0] > 0).astype(float), ridge=1.0)
    strength = z @ weights
    low = 1 - float(label_rate(labels, "quality", keep))
    # Classes are sampled apart, so quantiles and losses take weights that restore the label rate.
    w = np.where(y == 1, (1 - low) / len(good), low / len(bad))
    order = np.argsort(strength, kind="stable")
    threshold = float(strength[order][min(len(y) - 1, np.searchsorted(np.cumsum(w[order]) / w.sum(), low))])
    return QualityModel(mean, scale, weights, threshold, fitted_slope(strength - threshold, y, w))


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, Bradley-Terry strength and score (0 to 1) of every whole text; null and empty texts have zero features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in text_slices(texts):
                x = features(utf8(texts, i, j))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(m.score(x)), pa.array(m.strength(x))], ["doc_id", "score", "strength"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, score, "doc_id long, score double, strength double")
