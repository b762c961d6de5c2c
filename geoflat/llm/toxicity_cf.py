"""Toxicity: counterfactual-regularised logistic regression.

Features of a text: its distinct words (lower case, outer punctuation stripped), hashed;
presence, not counts, so a single insult in a very long text counts in full. The loss is the
class-balanced logistic loss plus an adaptive L1 penalty (the weaker the evidence that the
classes use a word unequally, the higher its price; words that only chance ties to a label
stay at zero, and those that pass are fitted again without the penalty; weights are never negative, so no amount of neutral text hides an
insult) plus
``FAIRNESS * mean((score logit of a labelled sentence - of its counterfactual)^2)``.
Counterfactuals of a labelled sentence: every identity term in it is replaced by another of
the same list; a sentence without any gets a neutral mention of one group on one side and of
another group on the other side, and is also compared with the sentence as it was. So
neither which group is named nor that one is named should move a score.

The labelled sample is bounded (``TRAIN_ROWS``); scoring covers every row. Labels, language,
source and id are no inputs of a score.

Defined cases: null, empty and blank texts have no features and score by the bias alone.
Without usable labels every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .common import texts_of
from .labelled import Sample, arrow_scores, features_of_sample, shift_to_threshold, training_ids

HASH_BITS = 31              # wide enough that words practically never share an entry
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
TRAIN_ROWS = 6_000
STEPS, ROUNDS, L1, L2, FAIRNESS = 300, 8, 0.1, 1e-4, 1.0
WORD_TABLE = 100_000

# Identity terms; terms of one list are exchanged for each other.
IDENTITY_TERMS = {
    "faith": "muslim christian jewish hindu buddhist sikh atheist catholic".split(),
    "origin": "african asian european american arab mexican german french spanish indian".split(),
    "colour": "black white brown".split(),
    "gender": "woman man women men female male girl boy transgender".split(),
    "orientation": "gay straight lesbian heterosexual bisexual".split(),
    "age": "old young elderly teenage".split(),
    "body": "deaf blind disabled paralyzed".split(),
    "croyance": "musulman chrétien juif hindou bouddhiste athée catholique".split(),
    "herkunft": "muslimisch christlich jüdisch türkisch polnisch afrikanisch".split(),
    "origen": "musulmán cristiano judío gitano africano asiático".split(),
}
_GROUP = {t: k for k, ts in IDENTITY_TERMS.items() for t in ts}
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_GROUP, key=len, reverse=True)) + r")(?!\w)", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n", re.ASCII)
_ENDS = ".,;:!?\"'()[]{}*#&$%|<>-_"



class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        w = word.decode("utf-8", "replace").lower()
        h = self[word] = xxhash.xxh3_64_intdigest(
            (w.strip(_ENDS) or w).encode("utf-8", "replace")) >> (64 - HASH_BITS)
        return h


_WORDS = _Words()


def forget_words() -> None:
    _WORDS.clear()


def entries_of(text: str | None) -> set[int]:
    """Hashes of the distinct words."""
    return set(map(_WORDS.__getitem__, set((text or "").encode("utf-8", "surrogatepass").split())))


def featurize(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = entries_of(text)
    idx = np.fromiter(found, dtype=np.int32, count=len(found))
    idx.sort()
    return idx, np.ones(len(idx), np.float32)


def sentence_of(text: str | None) -> str | None:
    """The first sentence that names a group, else the first one, else None."""
    parts = [p for p in _SENTENCE_END.split(text or "") if p]
    return next((p for p in parts if _TERM.search(p)), parts[0] if parts else None)


def counterfactuals(text: str, pick: int) -> list[tuple[str, str]]:
    """Pairs of sentences that should score alike. ``pick`` chooses terms, so results are
    the same in every run."""
    def swap(m: re.Match) -> str:
        terms = IDENTITY_TERMS[_GROUP[m[0].lower()]]
        at = terms.index(m[0].lower())
        return terms[(at + 1 + pick % (len(terms) - 1)) % len(terms)]

    if _TERM.search(text):
        return [(text, _TERM.sub(swap, text))]
    lists = list(IDENTITY_TERMS.values())
    terms = lists[pick % len(lists)]
    a, b = terms[pick % len(terms)], terms[(pick + 1) % len(terms)]
    words = text.split(" ")
    at = pick % (len(words) + 1)
    named = [" ".join([*words[:at], t, *words[at:]]) for t in (a, b)]
    return [(named[0], named[1]), (text, named[0])]


class _Rows:
    """Sparse 0/1 matrix over the kept features: products by bincount."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.n, self.columns = len(rows), columns
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    def only(self, place: np.ndarray, columns: int) -> "_Rows":
        """The columns with ``place`` >= 0, renumbered by it."""
        out = _Rows([], columns)
        at = place[self.col]
        out.n, out.row, out.col = self.n, self.row[at >= 0], at[at >= 0]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=self.columns)


class ToxicityModel:
    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.kept, self.weights, self.bias = kept, weights, bias


def train(sample: Sample, pairs: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS,
          fairness: float = FAIRNESS) -> ToxicityModel:
    """Accelerated proximal gradient over an active set: features whose gradient could pass
    the L1 penalty enter, the fit is repeated, and the set grows until no feature outside it
    violates the optimality condition."""
    y = sample.y
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    lists = [[sample.row(k)[0] for k in range(len(y))], [a for a, _ in pairs], [b for _, b in pairs]]
    entries = np.unique(np.concatenate([np.zeros(0, np.int64), *(i for li in lists for i in li)]))
    dim = len(entries)
    x, left, right = (_Rows([np.searchsorted(entries, i) for i in li], dim) for li in lists)
    cost = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    each = 2 * fairness / max(1, len(pairs))
    toxic, clean = y.sum(), (1 - y).sum()
    share1, share0 = x.back(y) / toxic, x.back(1 - y) / clean
    mean = (x.back(np.ones(len(y))) + 1) / (len(y) + 2)
    evidence = (share1 - share0) / np.sqrt(mean * (1 - mean) * (1 / toxic + 1 / clean))
    price = L1 / np.maximum(evidence, 1e-3)

    def slopes(x, left, right, w, bias):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -35, 35)))
        r = cost * (p - y)
        push = each * (left.dot(w) - right.dot(w))
        return x.back(r) + left.back(push) - right.back(push) + L2 * w, r.sum()

    w, bias, active = np.zeros(dim), 0.0, np.zeros(0, np.int64)
    for turn in range(ROUNDS):
        g, _ = slopes(x, left, right, w, bias)
        wanted = np.union1d(active, np.flatnonzero(-g > price * (0.7 if not turn else 1.001)))
        # the last fit keeps the selected words and frees their weights from the penalty
        last = turn == ROUNDS - 1 or (turn > 0 and len(wanted) == len(active))
        active = np.flatnonzero(w) if last else wanted
        l1 = 0.0 if last else price[active]
        place = np.full(dim, -1)
        place[active] = np.arange(len(active))
        xs, ls, rs = (m.only(place, len(active)) for m in (x, left, right))
        per_row = np.bincount(xs.row, minlength=xs.n)
        bound = 0.25 * xs.back(cost * (per_row + 1)) + L2 + 2 * each * (
            ls.back(np.bincount(ls.row, minlength=ls.n)) + rs.back(np.bincount(rs.row, minlength=rs.n)))
        bound = np.maximum(bound, 1e-6)
        bias_bound = 0.25 * (cost * (per_row + 1)).sum()
        now, ahead, b_now, b_ahead, t = w[active], w[active], bias, bias, 1.0
        for _ in range(steps):
            g, gb = slopes(xs, ls, rs, ahead, b_ahead)
            step = ahead - g / bound
            nxt = np.maximum(0.0, step - l1 / bound)
            b_nxt = b_ahead - gb / bias_bound
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, b_ahead = nxt + (t - 1) / t2 * (nxt - now), b_nxt + (t - 1) / t2 * (b_nxt - b_now)
            now, b_now, t = nxt, b_nxt, t2
        w[:] = 0
        w[active], bias = now, b_now
        if last:
            break
    kept = np.flatnonzero(w)
    return ToxicityModel(entries[kept], w[kept], shift_to_threshold(x.dot(w), y, THRESHOLD))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = TRAIN_ROWS, sentences: int = 3000) -> ToxicityModel:
    """The sample's features come from whole texts; counterfactuals from up to ``sentences``
    labelled sentences (a line each), at most one a document."""
    ids = training_ids(labels, label_col, FOLDS, HELD_OUT, rows)
    sample = features_of_sample(docs, ids, featurize, id_col, text_col)
    some = ids.orderBy(F.xxhash64("t_id"), "t_id").limit(sentences)
    texts = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
             .join(F.broadcast(some), F.col("id") == F.col("t_id")).select("id", "text"))
    found = StructType([texts.schema["id"], StructField("s", StringType())])
    arrow = to_arrow_schema(found)

    def pick(batches):  # in Python, so that only texts of the sample are split
        for b in batches:
            picked = pa.array([sentence_of(t) for t in texts_of(b.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), picked], schema=arrow)

    sentences_ = texts.mapInArrow(pick, found).where("s is not null").toPandas().sort_values(["id", "s"])
    pairs = []
    for k, s in enumerate(sentences_["s"]):
        for a, b in counterfactuals(s, k):
            fa, fb = featurize(a)[0], featurize(b)[0]
            pairs.append((np.setdiff1d(fa, fb), np.setdiff1d(fb, fa)))
    return train(sample, pairs)


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text"):
    """Column expression of the score of ``text_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (dict(zip(model.kept.tolist(), model.weights.tolist(), strict=True)), model.bias))

    def logit(text: str | None) -> float:
        weights, base = shared.value
        return base + sum(weights[h] for h in sorted(weights.keys() & entries_of(text)))

    return arrow_scores(F.col(text_col), logit, forget_words)
