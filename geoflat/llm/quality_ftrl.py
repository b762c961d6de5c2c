"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text: its words, word pairs, and the shapes of both (letters become one sign
per run, other characters stay, a word equal to the one before it gets its own sign), each
hashed to one of ``DIM`` entries; the value is the logarithm of the count, and the vector has
length one. Only the text is read.

The labelled sample is bounded (``labelled.TRAIN_ROWS``); scoring covers every row in
Arrow batches with the weights (non-zero ones only) sent along.

Defined cases: null, empty and blank texts have no features and score by the bias alone, as
low quality when the sample has any. Without usable labels every score is 0.5. Ids in the
labels that no document has are ignored; repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Sample, arrow_scores, features_of_sample, shift_to_threshold, training_ids

DIM_BITS = 20
DIM = 1 << DIM_BITS
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.05, 0.5
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
TRAIN_ROWS = 4_000
WORD_TABLE = 100_000

_U = np.uint64
_RUNS = re.compile(r"[^\W\d_]+")


def _shape(word: str) -> str:
    def sign(m: re.Match) -> str:
        s = m[0]
        return "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "Aa"
    return re.sub(r"\d+", "0", _RUNS.sub(sign, word))


class _Words(dict):
    """(hash of the word, hash of its shape) in a bounded table."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= WORD_TABLE:
            self.clear()
        w = word.decode("utf-8", "replace")
        v = self[word] = (xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "replace")),
                          xxhash.xxh3_64_intdigest(_shape(w).encode("utf-8", "replace"), seed=7))
        return v


_WORDS = _Words()


def forget_words() -> None:
    _WORDS.clear()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _U(0x9E3779B97F4A7C15)) ^ (b + _U(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def featurize(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a unit-length vector; empty for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    got = np.array(list(map(_WORDS.__getitem__, words)), dtype=_U)
    w, s = got[:, 0], got[:, 1]
    same = np.concatenate([[False], w[1:] == w[:-1]])
    s = np.where(same, _U(11), s)
    w_pairs = np.where(same[1:], _U(12), _pair(w[:-1], w[1:]))
    grams = np.concatenate([w, s, w_pairs, _pair(s[:-1] + _U(3), s[1:])])
    idx, n = np.unique((grams >> _U(64 - DIM_BITS)).astype(np.int32), return_counts=True)
    val = np.log1p(n).astype(np.float32)
    return idx, val / np.linalg.norm(val)


class FtrlModel:
    """Per-coordinate FTRL-Proximal; entry ``DIM`` is the bias."""

    def __init__(self):
        self.z = np.zeros(DIM + 1)
        self.n = np.zeros(DIM + 1)
        self.shift = 0.0

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, i: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def train(sample: Sample, epochs: int = EPOCHS, seed: int = 5) -> FtrlModel:
    """Both classes weigh the same in total; the order of examples is fixed."""
    model = FtrlModel()
    y = sample.y
    if not len(y) or y.min() == y.max():
        return model
    share = y.mean()

    def row(k: int) -> tuple[np.ndarray, np.ndarray]:
        i, v = sample.row(k)
        return np.append(i, DIM), np.append(v, np.float32(0.2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            model.update(*row(k), y[k], 0.5 / (share if y[k] else 1 - share))
    z = np.array([model.weights(i) @ x for i, x in map(row, range(len(y)))])
    model.shift = shift_to_threshold(z, y, THRESHOLD)
    return model


def scored(docs: DataFrame, model: FtrlModel, text_col: str = "text") -> "F.Column":
    """Column expression of the score of ``text_col``."""
    spark = docs.sparkSession
    w = model.weights(np.arange(DIM + 1)).astype(np.float32)
    shared = spark.sparkContext.broadcast((w[:DIM], float(w[DIM]) * 0.2 + model.shift))

    def logit(text: str | None) -> float:
        weights, base = shared.value
        i, v = featurize(text)
        return base + float(weights[i] @ v)

    return arrow_scores(F.col(text_col), logit, forget_words)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = TRAIN_ROWS) -> FtrlModel:
    ids = training_ids(labels, label_col, FOLDS, HELD_OUT, rows)
    return train(features_of_sample(docs, ids, featurize, id_col, text_col))
