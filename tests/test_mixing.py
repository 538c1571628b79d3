"""Learners over tables against plain online algorithms, one part and several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhetree.operators import learn as L
from rhetree.operators import mixing as X


def step(kind, y, score, norm, c=1.0, eta=1.0):
    if kind == "perceptron":
        return eta * y if y * score <= 0 else 0.0
    loss = max(0.0, 1 - y * score)
    return y * (min(c, loss / norm) if kind == "pa" else loss / (norm + 1 / (2 * c))) if loss and norm else 0.0


def mixed(parts, n, epochs, move):
    """Weights and their sums over the steps, mixed after each epoch; move(w, row) gives the new weights."""
    w, total = np.zeros(n), np.zeros(n)
    for _ in range(epochs):
        ends, sums = [], []
        for rows in parts:
            own, add = w.copy(), np.zeros(n)
            for row in rows:
                own = move(own, row)
                add += own
            ends.append(own)
            sums.append(add)
        w, total = np.mean(ends, axis=0), total + np.mean(sums, axis=0)
    return w, total


@pytest.mark.parametrize("kind", ["perceptron", "pa", "pa2"])
@pytest.mark.parametrize("n_parts", [1, 3])
def test_linear(spark, kind, n_parts):
    rng, n = np.random.default_rng(n_parts), 40
    rows = []
    for k in range(90):
        ix = rng.choice(n, rng.integers(0, 6), replace=False)
        rows.append((k % n_parts, k, float(rng.choice([-1, 1])), [(int(i) * 10**9, float(rng.normal())) for i in ix]))
    frame = spark.createDataFrame(rows, f"part int, seq int, y double, items {X.ITEMS}").repartition(4)

    def move(w, row):
        x = np.zeros(n)
        for i, v in row[3]:
            x[i // 10**9] = v
        return w + step(kind, row[2], x @ w, x @ x) * x

    want = mixed([[r for r in rows if r[0] == p] for p in range(n_parts)], n, 3, move)
    for average in (False, True):
        got = np.zeros(n)
        for r in X.train_linear(frame, kind, epochs=3, average=average).collect():
            got[r.feature_ix // 10**9] = r.w
        assert got == pytest.approx(want[average])


@pytest.mark.parametrize("kind", ["perceptron", "pa", "pa2"])
@pytest.mark.parametrize("n_parts", [1, 3])
def test_structured(spark, kind, n_parts):
    rng, n = np.random.default_rng(5), 12
    rows = []
    for d in range(14):
        for c in range(3):
            gold = rng.integers(3)
            rows += [(f"g{d:02}", 10 * c + p, f"p{p}", f"c{c}", bool(p == gold), [(int(i), float(rng.normal())) for i in rng.choice(n, 3, replace=False)]) for p in range(3)]
    frame = spark.createDataFrame(rows, f"grouping string, pair_ix long, parent string, child string, gold boolean, items {X.ITEMS}").repartition(3)

    def decode(doc, scores):
        out = np.zeros(len(doc), bool)
        for c in sorted(set(doc["child"])):
            at = np.flatnonzero((doc["child"] == c).to_numpy())
            out[at[np.argmax(scores[at])]] = True
        return out

    part = {r.grouping: r.p for r in frame.select("grouping", F.pmod(F.xxhash64("grouping"), F.lit(n_parts)).alias("p")).distinct().collect()}
    docs = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        docs.setdefault(r[0], []).append(r)

    def move(w, doc):
        x = np.zeros((len(doc), n))
        for k, r in enumerate(doc):
            for i, v in r[5]:
                x[k, i] += v
        gold = np.array([r[4] for r in doc])
        chosen = np.zeros(len(doc), bool)
        for c in range(3):
            at = [k for k, r in enumerate(doc) if r[3] == f"c{c}"]
            chosen[at[int(np.argmax((x @ w)[at]))]] = True
        cost = 1 - (gold & chosen).sum() / gold.sum()
        if cost <= 0:
            return w
        towards = x[gold].sum(axis=0) - x[chosen].sum(axis=0)
        norm, loss = towards @ towards, max(0.0, -towards @ w + cost**0.5)
        return w + (1.0 if kind == "perceptron" else 0.0 if not norm else min(1.0, loss / norm) if kind == "pa" else loss / (norm + 0.5)) * towards

    groups = [[docs[g] for g in sorted(docs) if part[g] == p] for p in range(n_parts)]
    want = mixed([g for g in groups if g], n, 2, move)
    for average in (False, True):
        assert L.weight_vector(X.train_structured(frame, decode, n_parts, kind, epochs=2, average=average), n) == pytest.approx(want[average])


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([], f"part int, seq int, y double, items {X.ITEMS}")
    assert X.train_linear(frame).collect() == []
    one = spark.createDataFrame([(0, 0, 1.0, []), (0, 1, -1.0, None)], frame.schema)
    assert X.train_linear(one).collect() == []
    with pytest.raises(ValueError, match="kind"):
        X.train_linear(frame, "other")
