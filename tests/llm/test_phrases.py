"""Phrase counts, scores and ranks against plain counting."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rhetree.llm import phrases as P


def plain(rows, least, longest, top):
    total, count = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    inner = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= found[lang, w[i : i + k]]}
    by = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in inner:
            score, k = min((1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return [(lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, own in by.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]


@pytest.mark.parametrize("seed,least,top", [(1, 5, 2000), (2, 30, 7), (3, 1, 2000)])
def test_collocations(spark, seed, least, top):
    rng = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "x", "x\u00a0y", "\u2003", "\x1c", "zz"] + [f"w{i}" for i in range(20)]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!", " ; "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([None, "", " .", text(rng.randrange(60))])) for _ in range(150)]
    rows += [("en", "new york city hall is"), ("en", "... new york!! ")] * 40 + [("de", text(3000)), ("fr", "a " * 500)]
    docs = spark.createDataFrame([(*r, 1, "n", "p") for r in rows], "lang string, text string, doc_id int, n string, phrase string").repartition(5)
    got = sorted(tuple(r) for r in P.collocations(docs, least=least, top=top).collect())
    want = sorted(plain(rows, least, 5, top))
    assert got == want and got


def test_empty_and_none_frequent(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert P.phrase_digest(docs.limit(0)).collect() == [] and P.phrase_digest(docs).collect() == []
    assert P.collocations(docs, least=1, longest=2).count() == 2


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of a very large corpus, whose products take over 64 bits."""
    counted = spark.createDataFrame([("en", "a", 3 * 10**12, 1), ("en", "b", 7 * 10**12 + 1, 1), ("en", "a b", 10**12 + 7, 2)], "lang string, phrase string, n long, words int")
    totals = spark.createDataFrame([("en", 2 * 10**16 + 3)], "lang string, n long")
    monkeypatch.setattr(P, "frequent_phrases", lambda *_: (counted, totals))
    row = P.collocations(spark.range(1).select(F.lit("").alias("text"), F.lit("").alias("lang"))).first()
    assert row.score == 1000 * (10**12 + 7) * (2 * 10**16 + 3) // (3 * 10**12 * (7 * 10**12 + 1))


def test_a_saturated_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_BITS", 64)
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(200))) for _ in range(20)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in P.collocations(docs, least=10).collect()) == sorted(plain(rows, 10, 5, 2000))


def test_slices_of_batches(spark, monkeypatch):
    """Batches cut into several slices of texts, which begin within the batch's bytes."""
    texts = pa.array(["Ab É x", "éé, É b", "", "C é.d\tE"] * 3)
    for at in range(len(texts)):
        words = P.Words(texts.slice(at))
        got = words.names.take(pa.array(words.id)).to_pylist()
        assert got == [w for t in texts.slice(at).to_pylist() for w in re.findall(r"[^ \t.,]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    monkeypatch.setattr(P, "ENCODE_BYTES", 50)
    rows = [("en", f"É New York, ünja{i % 3} new York") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert sorted(tuple(r) for r in P.collocations(docs, least=10).collect()) == sorted(plain(rows, 10, 5, 2000))
