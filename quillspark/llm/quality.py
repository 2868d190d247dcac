"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes ``FEATURES`` numbers about its form (shares of kinds of characters,
repetition, lengths). Pairs of a good and a bad labelled row are drawn, and weights are
learned by logistic loss on the difference of their features, so a score says how likely
a text would win against another. The threshold is the quantile of the training rows'
scores at the share of bad rows; scores are mapped to 0..1 so that it lies at ``CUT``.

Labelled rows whose crc32(doc_id) mod 4 is ``HELD`` are never learned from. The model is
fitted on the ``SAMPLE`` others with the least hash of doc_id and ``PAIRS`` pairs, bounds
that hold the driver's share constant; every whole text is scored.

Cases: null and empty texts have zero features and a score like any other; very long texts
are measured whole; texts of equal features tie, and a score of just ``CUT`` counts as good;
without labelled rows of both kinds every score is ``CUT``; rows that repeat a doc_id are
scored each, but learned from once (by their least text and the greatest of the doc_id's
labels); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linear import fit_logistic, sample, sigmoid

SAMPLE, PAIRS, HELD, CUT, SEED = 8000, 40_000, 2, 0.7, 7
FEATURES = 22
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = [9, 10, 11, 12, 13, 32]
_STOPS = [ord(c) for c in ".,;:"]
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS]


def features(text: str | None) -> list[float]:
    """Numbers about a text's form; all zero for an empty one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * FEATURES
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    letters, upper = max(int(h[_LETTER].sum()), 1), int(h[65:91].sum())
    marks = h[_MARKS]
    w = raw.split()
    k = max(len(w), 1)
    count = Counter(w)
    lines = raw.split(b"\n")
    pairs = len(set(zip(w, w[1:], strict=False)))
    lens = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) if w else np.zeros(1)
    stops = int(h[_STOPS].sum())
    return [
        letters / n, upper / letters, int(h[48:58].sum()) / n, int(marks.sum()) / n, int(marks.max()) / n, int(marks.sum()) / k, stops / k,
        int(h[_SPACE].sum()) / n, int(h[128:].sum()) / n, len(count) / k, len(count) / k**0.75, max(count.values(), default=0) / k,
        pairs / k, float(lens.mean()) / 10, float(lens.std()) / 10, float(lens.max()) ** 0.5 / 10, log1p(k) / 10, k / len(lines) / 100,
        len(set(lines)) / len(lines), int((marks > 0).sum()) / 10, int(h[33]) / k, float(sum(1 for v in count.values() if v == 1)) / k,
    ]


def _table(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), FEATURES)


class Ranker:
    """score(x) = sigmoid(slope * (weights . standardised x - threshold) + logit(CUT))."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, slope: float):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT)))


def fit_pairs(x: np.ndarray, y: np.ndarray) -> Ranker:
    """A ranker from features and labels 0/1 of which both occur."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    sign = np.where(rng.random(PAIRS) < 0.5, 1.0, -1.0)
    w = fit_logistic(diff * sign[:, None], (sign > 0).astype(float), l2=5.0, intercept=False)
    raw = z @ w
    return Ranker(mean, scale, w, float(np.quantile(raw, len(bad) / len(y))), 1.0)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD


def fit(documents: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from SAMPLE labelled rows at most, none of them held out."""
    rows = sample(documents, labels, "quality", SAMPLE, ~held_out(F.col("doc_id"))).select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _table(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy("doc_id").toPandas()
    y = got.quality.to_numpy()
    if len(set(y)) < 2:
        return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    return fit_pairs(np.stack(list(got.x)), y)


def score(documents: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(ranker.scores(_table(b.column("text").to_pylist())))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
