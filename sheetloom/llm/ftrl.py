"""Follow-the-regularised-leader logistic regression on hashed sparse features.

Training reads a bounded, documented number of labelled rows and runs as one task on an executor;
what reaches the driver is a weight vector of fixed length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2; coordinate 0 is the unpenalised bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1e-3):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if idx is None else (self.z[idx], self.n[idx])
        w = -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        bias = np.zeros(len(w), bool) if idx is not None else np.arange(len(w)) == 0
        if idx is not None:
            bias = idx == 0
        return np.where(bias, -z / ((self.beta + np.sqrt(n)) / self.alpha), w)

    def step(self, idx: np.ndarray, grad: np.ndarray, w: np.ndarray) -> None:
        """One update with gradient ``grad`` at the coordinates ``idx``, which must be distinct."""
        n = self.n[idx]
        sigma = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha
        self.z[idx] += grad - sigma * w
        self.n[idx] = n + grad * grad

    def learn(self, idx: np.ndarray, val: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(idx)
        p = 1 / (1 + np.exp(-np.clip(w @ val, -30, 30)))
        self.step(idx, weight * (p - y) * val, w)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``per_class`` training rows of each label, smallest id hash first.

    Held-out documents, null labels and null ids never train. The rows chosen are bounded by
    2 * per_class, so they are broadcast to the documents.
    """
    ok = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    ok = ok.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ok.where("y = 0").orderBy(*order).limit(per_class).unionByName(ok.where("y = 1").orderBy(*order).limit(per_class))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.join(F.broadcast(chosen), "doc_id")


def train(features: DataFrame, fit, size: int) -> np.ndarray:
    """Weights from ``fit(rows)``, run as one task over the bounded ``features`` (doc_id, y, idx, val)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True) if (batches := list(batches)) else pd.DataFrame(columns=["doc_id", "y", "idx", "val"])
        rows = rows.sort_values("doc_id", kind="stable")
        w = fit(rows).astype(np.float32)
        for lo in range(0, size, 65536):
            yield pd.DataFrame({"lo": [lo], "w": [w[lo : lo + 65536].tobytes()]})

    got = features.repartition(1).mapInPandas(run, "lo long, w binary").collect()
    out = np.zeros(size, np.float32)
    for r in got:
        part = np.frombuffer(bytes(r["w"]), np.float32)
        out[r["lo"] : r["lo"] + len(part)] = part
    return out
