"""Quality classifier: hashed word n-gram logistic regression trained with FTRL updates.

Features of a text are word unigrams and bigrams in two alphabets: the words themselves, and their
shapes (case, letters, the marks at their end, whether a word repeats the one before). Each n-gram
is hashed to one of 2^18 coordinates; its value is its share of the text's n-grams, so a score is
the mean weight of a text's n-grams: a sparse dot product computed by table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .ftrl import Ftrl, labelled_sample, train

BITS = 18
SIZE = 1 << BITS
MASK = np.uint64(SIZE - 1)
#: Documented bound of the training sample: rows of each label.
PER_CLASS = 3000
EPOCHS = 3
#: Values are shares times this, which sets their scale against the bias.
SCALE = 20.0
#: Words that a worker remembers before it starts afresh.
CACHE = 400_000
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Case, kind and final marks of a word, e.g. ``Abc%%%`` gives ``Aa%``."""
    core = word.rstrip(".,;:!?#*$%&|<>")
    kind = "0" if any(c.isdigit() for c in core) else "AA" if len(core) > 1 and core.isupper() else "Aa" if core[:1].isupper() else "a" if core.isalpha() else "-" if core else ""
    tail = word[len(core) :]
    return kind + tail[:2]


class Hasher(dict):
    """Word to (hash of the word, hash of its shape), remembered."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > CACHE:
            self.clear()
        got = self[word] = (xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 1), xxhash.xxh64_intdigest(shape(word).encode("utf-8", "surrogatepass"), 2))
        return got


def ngrams(text: str, hasher: Hasher) -> np.ndarray:
    """Coordinates, repeats included, of the n-grams of a text; a text without words has one of its own."""
    toks = text.split()
    if not toks:
        return np.array([1], np.int64)
    h = np.array([hasher[t] for t in toks], np.uint64)
    word, form = h[:, 0], h[:, 1]
    same = (word[1:] == word[:-1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        pairs = word[:-1] * _MIX + word[1:]
        forms = form[:-1] * _MIX + form[1:] + same * np.uint64(0x51ED270B)
        grams = np.concatenate([word, form, pairs ^ (pairs >> np.uint64(29)), forms ^ (forms >> np.uint64(31))])
    return ((grams & MASK) | np.uint64(2)).astype(np.int64)


def features(sample: DataFrame) -> DataFrame:
    """``(doc_id, y, idx, val)``: the sparse vector of each text, coordinates distinct; 0 is the bias."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            idx, val = [], []
            for t in pdf["text"]:
                i, c = np.unique(ngrams(t, hasher), return_counts=True)
                idx.append(np.r_[0, i].astype(np.int32))
                val.append(np.r_[1.0, SCALE * c / c.sum()].astype(np.float32))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "idx": idx, "val": val})

    return sample.mapInPandas(run, "doc_id long, y int, idx array<int>, val array<float>")


def fit_rows(rows: pd.DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    model, rng = Ftrl(SIZE, alpha=0.6, l1=0.02, l2=1e-4), np.random.default_rng(7)
    y = rows["y"].to_numpy(float)
    share = max(y.mean(), 1e-3) if len(y) else 0.5
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            weight = 0.5 / share if y[k] else 0.5 / max(1 - share, 1e-3)
            model.learn(np.asarray(rows["idx"].iat[k]), np.asarray(rows["val"].iat[k], float), y[k], min(weight, 20.0))
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights learned from at most ``per_class`` labelled rows of each class outside the held-out fifth."""
    return train(features(labelled_sample(docs, labels, "quality", per_class)), fit_rows, SIZE)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    A null text counts as empty and has the score of a text without words. Whole texts of any
    length are scored. Repeated rows, null ids and empty tables give as many rows as they have.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            z = [SCALE * weights[ngrams(t, hasher)].mean(dtype=np.float64) + float(weights[0]) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))})

    id_type = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = slim.mapInPandas(run, f"doc_id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``labels``, then ``score`` all of ``docs``; with no usable label every score is one half."""
    return score(docs, fit(docs, labels, per_class), threshold)
