"""Encoders: texts to unit vectors, as Arrow-batched Column functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS, DIM, LO, HI, MOST = 1 << 14, 256, 3, 5, 1500


def encode(col: Column | str, encoder: Callable[[list[str]], np.ndarray]) -> Column:
    """array<float> of each text by any function from texts to rows of a matrix, made of unit length."""

    def run(s: pd.Series) -> pd.Series:
        x = np.asarray(encoder([t or "" for t in s]), dtype=np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(x.astype(np.float32)))

    return F.pandas_udf(run, "array<float>")(col)


def bucket(gram: str, buckets: int = BUCKETS) -> int:
    """32-bit FNV-1a over code points, modulo ``buckets``."""
    h = 2166136261
    for ch in gram:
        h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
    return h % buckets


class RandomProjection:
    """1 + ln(count) of hashed character n-grams times a sparse matrix of -1, 0 and 1 (shares 1/6, 2/3, 1/6)."""

    def __init__(self, dim: int = DIM, buckets: int = BUCKETS, seed: int = 0):
        self.dim, self.buckets, self.seed = dim, buckets, seed

    def __call__(self, texts: list[str]) -> np.ndarray:
        matrix = np.random.default_rng(self.seed).choice(np.array([-1, 0, 1], dtype=np.int8), size=(self.buckets, self.dim), p=(1 / 6, 2 / 3, 1 / 6))
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            t = " ".join(t.split())[:MOST]
            counts = np.zeros(self.buckets)
            for n in range(LO, HI + 1):
                for k in range(len(t) - n + 1):
                    counts[bucket(t[k : k + n], self.buckets)] += 1
            some = np.flatnonzero(counts)
            out[i] = (1 + np.log(counts[some])) @ matrix[some]
        return out


def onnx_encoder(path: str, tokenize: Callable[[list[str]], dict], pooling: str = "mean") -> Callable[[list[str]], np.ndarray]:
    """An encoder from an ONNX model whose first output is (batch, token, dim); tokenize gives its inputs."""

    def run(texts: list[str]) -> np.ndarray:
        import onnxruntime

        inputs = tokenize(texts)
        states = onnxruntime.InferenceSession(path).run(None, inputs)[0]
        if pooling == "cls":
            return states[:, 0]
        mask = inputs["attention_mask"][:, :, None]
        return (states * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)

    return run
