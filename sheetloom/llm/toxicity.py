"""Toxicity: a counterfactual-regularised linear classifier.

A text is the set of its words; each word brings itself and its beginnings of three to six letters,
hashed. The model is trained by FTRL on the logistic loss plus a penalty. Each labelled sentence, of
either label, is scored beside a copy of it in which an identity term is swapped for another (where
it has none, two copies with one term each are scored), and the squared difference of the two
scores is added to the loss. A neutral mention of a group thereby doesn't raise the score.
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

# Identity terms that are swapped for one another.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist",
    "gay", "lesbian", "straight", "bisexual", "transgender", "black", "white", "asian", "latino", "african",
    "european", "american", "mexican", "chinese", "german", "french", "spanish", "arab", "turkish", "polish",
    "immigrants", "refugees", "elderly", "teenagers", "blind", "deaf", "disabled",
    "frauen", "männer", "juden", "muslime", "christen", "femmes", "hommes", "juifs", "musulmans", "chrétiens",
    "mujeres", "hombres", "judíos", "musulmanes", "cristianos",
)

BITS = 18
SIZE = 1 << BITS
#: Documented bound of the training sample: rows of each label.
PER_CLASS = 3000
EPOCHS = 4
#: L1 strength per training row: only words that keep going with toxic labels keep a weight.
L1_PER_ROW, LEAST_L1 = 1e-3, 0.3
#: Weight of the squared difference of the scores, between 0 and 1, of two counterfactual versions.
PENALTY = 8.0
CACHE = 400_000
THRESHOLD = 0.5
MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_«»¡¿"


def parts(word: str) -> list[int]:
    """Coordinates of a lower-case word without marks: the word, and its beginnings of 3 to 6 letters."""
    grams = [word + "$", *(word[:k] + "*" for k in range(3, 7) if len(word) >= k)] if word else []
    return [2 + xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 5) % (SIZE - 2) for g in grams]


def vector(words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates with the number of distinct words that have them; 0 is the bias."""
    idx, n = np.unique(np.array([i for w in words for i in parts(w)], np.int64), return_counts=True)
    return np.r_[0, idx].astype(np.int32), np.r_[1, n].astype(np.float32)


def _cores(text: str) -> set[str]:
    """Distinct words in lower case without the marks around them."""
    return {w.strip(MARKS) for w in set(text.lower().split())}


def features(sample: DataFrame) -> DataFrame:
    """``(doc_id, y, idx, val, terms)``; terms are the identity terms that the text has."""
    known = set(IDENTITY_TERMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [_cores(t) for t in pdf["text"]]
            vec = [vector(s) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "idx": [v[0] for v in vec], "val": [v[1] for v in vec], "terms": [sorted(s & known) for s in sets]})

    return sample.mapInPandas(run, "doc_id long, y int, idx array<int>, val array<float>, terms array<string>")


def rewritten(idx: np.ndarray, val: np.ndarray, out: str | None, into: str) -> tuple[np.ndarray, np.ndarray]:
    """The vector of a sentence once the term ``out`` is replaced by ``into``, or ``into`` is added."""
    changed = [(np.array(parts(t), np.int64), step) for t, step in ((out, -1.0), (into, 1.0)) if t]
    at = np.concatenate([idx, *[i for i, _ in changed]])
    new, place = np.unique(at, return_inverse=True)
    total = np.bincount(place, np.concatenate([val, *[np.full(len(i), step) for i, step in changed]]))
    keep = total > 0
    return new[keep], total[keep]


def fit_rows(rows: pd.DataFrame, epochs: int = EPOCHS, penalty: float = PENALTY) -> np.ndarray:
    model, rng = Ftrl(SIZE, alpha=0.3, l1=max(LEAST_L1, L1_PER_ROW * len(rows)), l2=1e-3), np.random.default_rng(11)
    y = rows["y"].to_numpy(float)
    share = max(y.mean(), 1e-3) if len(y) else 0.5
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            weight = min(0.5 / share if y[k] else 0.5 / max(1 - share, 1e-3), 20.0)
            idx, val = np.asarray(rows["idx"].iat[k], np.int64), np.asarray(rows["val"].iat[k], float)
            model.learn(idx, val, y[k], weight)
            if not penalty:
                continue
            own = list(rows["terms"].iat[k])
            one, other = (own[rng.integers(len(own))] if own else IDENTITY_TERMS[rng.integers(len(IDENTITY_TERMS))]), IDENTITY_TERMS[rng.integers(len(IDENTITY_TERMS))]
            if one == other or other in own:
                continue
            a = (idx, val) if own else rewritten(idx, val, None, one)
            b = rewritten(idx, val, one if own else None, other)
            both = np.union1d(a[0], b[0])
            w = model.weights(both)
            at_a, at_b = np.searchsorted(both, a[0]), np.searchsorted(both, b[0])
            p, q = sigmoid(w[at_a] @ a[1]), sigmoid(w[at_b] @ b[1])
            if abs(p - q) > 1e-9:
                grad = np.zeros(len(both))
                grad[at_a] += p * (1 - p) * a[1]
                grad[at_b] -= q * (1 - q) * b[1]
                moved = np.flatnonzero(grad)
                model.step(both[moved], 2 * penalty * weight * (p - q) * grad[moved], w[moved])
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights learned from at most ``per_class`` labelled rows of each class outside the held-out fifth."""
    return train(features(labelled_sample(docs, labels, "toxic", per_class)), fit_rows, SIZE)


class Scorer(dict):
    """Word to the sum of its weights, remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        got = self[word] = float(self.weights[parts(word)].sum(dtype=np.float64))
        return got

    def logit(self, text: str) -> float:
        return float(self.weights[0]) + sum(map(self.__getitem__, _cores(text)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    A null text counts as empty and has the score of the bias alone. Whole texts of any length are
    scored. Repeated rows, null ids and empty tables give as many rows as they have.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(weights)
        for pdf in batches:
            z = np.array([scorer.logit(t) for t in pdf["text"]], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    id_type = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = slim.mapInPandas(run, f"doc_id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``labels``, then ``score`` all of ``docs``; with no usable label every score is one half."""
    return score(docs, fit(docs, labels, per_class), threshold)
