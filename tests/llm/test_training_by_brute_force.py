"""The draws and training steps that SQL cannot express, against plain versions: Pareto ranking,
FTRL features and updates, the counterfactual objective and the likelihood of the chain CRF."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoflat.llm import crf_extract, labelled, pareto_mix, quality_ftrl, toxicity_cf
from geoflat.llm.common import ship_package, uniform53


@pytest.mark.parametrize("count,longest", [(9000, 60), (120, 400)])  # with and without small documents
def test_pareto_ranking(spark, count, longest):
    ship_package(spark)
    rng = random.Random(count)
    rows = [(k, " ".join(["w%d" % (k + j) for j in range(int(longest ** rng.random()))]),
             rng.choice(["a", "a", "a", "b", "c", None])) for k in range(count)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    draws = {r[0]: r[1] for r in docs.select("doc_id", uniform53(
        F.lit(pareto_mix.SEED), F.col("doc_id"), F.col("text"))).collect()}
    got, target = {}, {}
    for r in pareto_mix.mix(docs).select("row.doc_id", "row.source", "target", "copies").collect():
        got[r["doc_id"]], target[r["source"]] = r["copies"], r["target"]
    by = defaultdict(list)
    for k, text, source in rows:
        by[source].append((k, len(text.split())))
    for source, members in by.items():
        total = sum(n for _, n in members)

        def share(scale, n):
            return min(3.0, scale * 2 ** (0.25 * (n.bit_length() - 1)))
        low, high = 0.0, 4.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(share(mid, n) * n for _, n in members) < target[source] else (low, mid)
        expected, ranked, certain = {}, {True: [], False: []}, 0
        for k, n in members:
            e = share(high, n)
            whole = math.floor(e + 1e-9)
            expected[k], p = whole, e - whole
            certain += whole * n
            if p > 1e-12:
                u = draws[k]
                ranked[n * 1000 > total].append(((u / (1 - u)) / (p / (1 - p)), k, n, p))
        room = sum(n * p for _, _, n, p in ranked[True])
        for _, k, n, _ in sorted(ranked[True]):
            if n <= room:
                room -= n
                certain += n
                expected[k] += 1
        lack = target[source] - certain
        for _, k, n, _ in sorted(ranked[False]):
            if n / 2 > lack:
                break
            lack -= n
            expected[k] += 1
        assert expected == {k: got[k] for k, _ in members}


def test_ftrl_features():
    def shape(word):
        out, k = "", 0
        while k < len(word):
            end = k + 1
            kind = "d" if word[k].isdecimal() else "l" if word[k].isalpha() else "s"
            while kind != "s" and end < len(word) and (word[end].isdecimal() if kind == "d" else word[end].isalpha()):
                end += 1
            run = word[k:end]
            out += "0" if kind == "d" else run if kind == "s" else (
                "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa")
            k = end
        return out
    full = 2 ** 64

    def pair(a, b):
        x = (a * 0x9E3779B97F4A7C15 % full) ^ ((b + 0xC2B2AE3D27D4EB4F) % full)
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % full
        return x ^ (x >> 32)
    for text in ["One two two-two 33 two two x9Y ABC!", "word", "a a a a", "", None]:
        words = (text or "").split()
        w = [xxhash.xxh3_64_intdigest(x.lower().encode()) for x in words]
        s = [xxhash.xxh3_64_intdigest(shape(x).encode(), seed=7) for x in words]
        same = [k > 0 and w[k] == w[k - 1] for k in range(len(w))]
        s = [11 if r else x for r, x in zip(same, s)]
        grams = w + s + [12 if same[k] else pair(w[k - 1], w[k]) for k in range(1, len(w))]
        grams += [pair(s[k - 1] + 3, s[k]) for k in range(1, len(s))]
        count = Counter(g >> (64 - quality_ftrl.DIM_BITS) for g in grams)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values()))
        idx, val = quality_ftrl.featurize(text)
        assert dict(zip(idx.tolist(), val.tolist())) == pytest.approx(
            {g: math.log1p(c) / norm for g, c in count.items()}, rel=1e-5)


def test_ftrl_updates():
    rng = np.random.default_rng(4)
    y = (rng.random(120) < 0.3).astype(float)
    rows = []
    for label in y:
        i = np.sort(rng.choice(np.arange(25) + 25 * int(label), 6, replace=False)).astype(np.int32)
        rows.append((i, rng.random(6).astype(np.float32)))
    model = quality_ftrl.train(labelled.Sample.of(y, rows))
    a, b, l1, l2 = quality_ftrl.ALPHA, quality_ftrl.BETA, quality_ftrl.L1, quality_ftrl.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((b + math.sqrt(n[i])) / a + l2)
    order = np.random.default_rng(5)
    for _ in range(quality_ftrl.EPOCHS):
        for k in order.permutation(len(y)):
            x = dict(zip(rows[k][0].tolist(), rows[k][1].tolist())) | {quality_ftrl.DIM: float(np.float32(0.2))}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y[k]) * v * 0.5 / (y.mean() if y[k] else 1 - y.mean())
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
                z[i] += g - sigma * w[i]
                n[i] += g * g
    at = np.append(np.arange(50), quality_ftrl.DIM)
    assert np.allclose(model.weights(at), [weight(i) for i in at.tolist()], atol=1e-4)
    assert np.count_nonzero(model.weights(at)) > 10


def test_counterfactual_objective():
    """The kept weights are where the plain objective over the kept words is least."""
    rng = np.random.default_rng(8)
    y = (np.arange(300) % 2).astype(float)
    rows = [(np.unique(np.concatenate([rng.choice(30, 5), [30 + rng.integers(6)] if v and rng.random() < 0.8 else [],
                                       [40] if rng.random() < (0.7 if v else 0.2) else []])).astype(np.int32)) for v in y]
    pairs = [(np.array([40]), np.array([41])) for _ in range(20)] + [(np.array([k]), np.array([k + 1])) for k in range(20)]
    sample = labelled.Sample.of(y, [(i, np.ones(len(i), np.float32)) for i in rows])
    model = toxicity_cf.train(sample, pairs, steps=20_000)
    kept = model.kept.tolist()
    assert len(kept) >= 3
    x = np.array([[float(h in set(r.tolist())) for h in kept] for r in rows])
    gap = np.array([[float(h in a) - float(h in b) for h in kept] for a, b in pairs])
    cost = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def objective(w, bias):
        z = x @ w + bias
        return ((cost * (np.logaddexp(0, z) - y * z)).sum() + toxicity_cf.FAIRNESS * ((gap @ w) ** 2).mean()
                + toxicity_cf.L2 / 2 * (w @ w))

    def best_bias(w):
        low, high = -30.0, 30.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if (cost * (1 / (1 + np.exp(-(x @ w + mid))) - y)).sum() < 0 else (low, mid)
        return low
    w = model.weights
    here = objective(w, best_bias(w))
    for k, step in itertools.product(range(len(w)), (-0.02, 0.02)):
        moved = w.copy()
        moved[k] = max(0.0, moved[k] + step)
        assert objective(moved, best_bias(moved)) >= here - 1e-9
    free = toxicity_cf.train(sample, pairs, steps=20_000, fairness=0.0)
    tied = dict(zip(kept, w)).get(40, 0.0)
    assert tied < dict(zip(free.kept.tolist(), free.weights))[40]


def test_crf_likelihood():
    """After training, the penalised likelihood over all label sequences has no slope left."""
    rng = random.Random(6)
    pages = []
    for _ in range(12):
        labels = [int(rng.random() < 0.5)]
        while len(labels) < rng.choice([1, 3, 5]):
            labels.append(labels[-1] if rng.random() < 0.8 else 1 - labels[-1])
        pages.append(([["bias", f"f{v if rng.random() < 0.7 else 1 - v}", f"g{rng.randrange(2)}"] for v in labels], labels))
    model = crf_extract.train(pages, steps=6000)
    names = sorted(model.weights)
    theta = np.array([model.weights[f] for f in names] + [v for r in model.move for v in r])
    blocks = sum(len(y) for _, y in pages)

    def loss(t):
        weight, move = dict(zip(names, t)), t[-4:].reshape(2, 2)

        def score(fs, y):
            return sum(weight[f] for b, v in zip(fs, y) if v for f in b) + sum(move[a][b] for a, b in zip(y, y[1:]))
        total = 0.0
        for fs, y in pages:
            every = [score(fs, s) for s in itertools.product((0, 1), repeat=len(y))]
            total += np.logaddexp.reduce(every) - score(fs, y)
        return total / blocks + crf_extract.L2 / 2 * (t @ t) / len(pages) ** 0.5
    slope = []
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        slope.append((loss(up) - loss(down)) / 2e-4)
    assert np.abs(slope).max() < 2e-3
    assert loss(theta) < loss(theta * 0) - 0.05
