"""Runs found by block convolution against all periods tried one by one."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from rhetree.llm import periodic_runs as R


def brute(words):
    """(start, period, length) of all runs."""
    n, out = len(words), {}
    for q in range(1, n // R.EXPONENT + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i - start + q
                if length >= max(R.LEAST, R.EXPONENT * q):
                    out.setdefault((start, length), q)
                start = None
    return sorted((s, q, n) for (s, n), q in out.items())


def words_like(rng, n):
    kinds = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a = rng.randrange(n)
        p, end = 1 + rng.randrange(max(1, (n - a) // 3)), rng.randrange(a, n + 1)
        for i in range(a, end):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs():
    rng = random.Random(1)
    for _ in range(300):
        x = words_like(rng, rng.choice([1, 5, 6, 7, 20, 40, 100, 300, 700]))
        got = [(s, q, n) for s, n, q in R.runs_of(np.array(x), len(x)).tolist()]
        assert got == brute(x)


def test_documents_side_by_side():
    rng = random.Random(2)
    for _ in range(60):
        docs = [words_like(rng, rng.choice([1, 6, 9, 30, 200, 600])) for _ in range(rng.randrange(1, 12))]
        at, runs = R._batch(np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs))
        assert sorted((i, s, q, n) for i, (s, n, q) in zip(at.tolist(), runs.tolist(), strict=True)) == [(i, *r) for i, d in enumerate(docs) for r in brute(d)]


@pytest.mark.parametrize("p,g,order", R.PRIMES)
@pytest.mark.parametrize("n", [2, 8, 64, 128, 4096])
def test_transform_is_exact(p, g, order, n):
    x = np.random.default_rng(n).integers(0, p, (2, n))
    root = pow(g, (p - 1) // n, p)
    got = R.ntt(x.astype(float), root, p) % p
    for k in (0, 1, n // 2, n - 1):
        for row in (0, 1):
            assert int(got[row, k]) == sum(int(v) * pow(root, i * k, p) for i, v in enumerate(x[row])) % p
    back = R.ntt(got, pow(root, p - 2, p), p) % p
    assert [int(v) * pow(n, p - 2, p) % p for v in back[0]] == x[0].tolist()


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_digest(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "é\u00a0é x\u2003y", "a b " * 40 + "c", "A a " * 9, "x y z " * 6 + "q " * 30]
    texts += [" ".join(f"w{i}" for i in words_like(rng, rng.choice([8, 50, 400]))) for _ in range(120)]
    rows = [(i if i else None, t, "r", 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, _words int")
    got = [tuple(r) for r in R.runs_digest(docs).collect()]
    assert sorted(got, key=repr) == sorted((digest(i, t) for i, t, *_ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20 and R.runs_digest(docs.limit(0)).collect() == []
    names = docs.selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert sorted((r.doc_id or "", r.runs_sha256) for r in R.runs_digest(names).collect()) == sorted((str(r[0] or ""), r[6]) for r in got)
    less = {r.doc_id: r for r in R.collapse_runs(docs).collect()}
    assert R.collapse_runs(docs).columns == docs.columns and less[6].text == "a b c" and less[2].text == " \n\t " and less[4].runs == "r"


def test_very_long_texts(spark):
    """A million words: all equal, of two kinds, and all different but for a long period."""
    n = 1_000_000
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 40, n // 5)
    began = time.time()
    assert R.runs_of(np.zeros(n, np.int64), n).tolist() == [[0, n, 1]]
    assert R.runs_of(np.tile(base, 5) + 7, n).tolist() == [[0, n, n // 5]]
    assert len(R.runs_of(rng.integers(0, 2, n), n)) > 1000
    assert time.time() - began < 120
    docs = spark.createDataFrame([(3, "one two three " * 100_000)], "doc_id long, text string")
    row = R.runs_digest(docs).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 300_000, 3)
