"""Labelled samples of bounded size, and logistic models fitted on them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(documents: DataFrame, labels: DataFrame, label: str, size: int, where: Column | None = None) -> DataFrame:
    """(doc_id, label, text, lang): a row for each of the ``size`` labelled doc_ids with the least hash, or as many as there are.

    A doc_id labelled more than once has the greatest label, and one with several texts the
    least; lang is null where documents have none.
    """
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.lit(True) if where is None else where))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias(label))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)  # so many numbers are broadcast
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("text", lang.alias("lang")).alias("x")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", label).agg(F.min("x").alias("x")).select("doc_id", label, "x.text", "x.lang")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25, intercept: bool = True) -> np.ndarray:
    """Weights (the intercept last) by Newton's method with an L2 penalty on all but the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))]) if intercept else x
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    if intercept:
        pen[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * s) @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
