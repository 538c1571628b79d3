"""Repeated passages against a brute-force paragraph join, and exact passages in the middle of lines."""

import random

import numpy as np
from pyspark.sql import functions as F

from rhetree.llm import shingles, substring_dedup

RNG = random.Random(12)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(3, 9))) for _ in range(3000)]


def prose(n, rng):
    return [rng.choice(VOCAB) for _ in range(n)]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def gone(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: np.zeros(len(t), bool) for i, t in enumerate(texts)}
    for r in substring_dedup.substring_digest(docs).collect():
        if r.removed:
            out[r.doc_id][r.start : r.end] = True
    return out


def test_edited_paragraphs(spark):
    rng = random.Random(5)
    lines, texts = [], []
    for n in (30, 60, 80, 100):
        for _ in range(6):
            one = prose(n, rng)
            two = [*one]
            two[n // 2] = "edited"
            lines += [one, two]
    for line in lines:
        texts.append("\n".join(" ".join(x) for x in (prose(30, rng), line, prose(25, rng))))
    found = gone(spark, texts)
    for i, line in enumerate(lines):
        begin = texts[i].index("\n") + 1
        whole = found[i][begin : begin + len(" ".join(line))].all()
        assert whole == any(jaccard(line, other) >= 0.8 for other in lines[:i]), (i, len(line))
        assert not found[i][: begin - 1].any()


def test_passages_inside_lines(spark):
    rng = random.Random(8)
    passages = [prose(n, rng) for n in range(51, 61) for _ in range(4)]
    texts = [" ".join([*prose(40, rng), f"left{k}", *p, f"right{k}", *prose(40, rng)]) for k in "ab" for p in passages]
    found = gone(spark, texts)
    for i, p in enumerate(passages):
        assert not found[i].any()
        copy = texts[len(passages) + i]
        begin = copy.index(" ".join(p))
        want = np.zeros(len(copy), bool)
        want[begin : begin + len(" ".join(p))] = True
        assert (found[len(passages) + i] == want).all()


def test_match_is_extended_to_any_earlier_copy(spark):
    rng = random.Random(9)
    core, tail = prose(40, rng), prose(9, rng)
    middle = [*core, *tail]
    texts = [" ".join([*prose(30, rng), f"l{i}", *p, f"r{i}", *prose(30, rng)]) for i, p in enumerate((core, middle, middle))]
    found = gone(spark, texts)
    assert [found[i].sum() for i in range(3)] == [0, len(" ".join(core)), len(" ".join(middle))]


def test_shared_words_share_a_window():
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(1, 1 << 62, n, dtype=np.uint64)
    for _ in range(50):
        passage, kept = new(35), []
        for before in (30, 41):
            words = np.concatenate([new(before), passage, new(30)])
            at, h = shingles.least_windows(words, np.zeros(len(words), np.int64), 18)
            kept.append(set(h[(at >= before) & (at + 18 <= before + 35)].tolist()))
        assert kept[0] & kept[1]


def test_kinds_of_a_window_are_led_by_the_first_occurrence_that_goes_on_alike(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text, size = rng.randrange(60), rng.choice((2, 5, substring_dedup.WINDOW - 1))
        rows.append((text, text % 7, i, rng.randrange(3), rng.random() < 0.5, [rng.randrange(2) for _ in range(size)]))
    rows += [(100, 1, 0, 1, True, []), (None, 2, 1, 1, True, [0, 1])]
    table = spark.createDataFrame(rows, "doc_id long, text_key long, at int, pid long, is_left boolean, near array<int>").cache()

    def alike(x, y):
        return next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))

    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2])
    want = {}
    for r in rows:
        others = [(alike(r[5], o[5]), o) for o in rows if o is not r and o[3:5] == r[3:5]]
        step = max((k for k, _ in others), default=0)
        gone = 0
        for k, o in others:
            if key(o) < key(r):
                same = o[0] == r[0] and o[1] == r[1]
                gone = max(gone, k if not same or r[2] - o[2] >= k + substring_dedup.WINDOW else min(k, max(r[2] - o[2] - substring_dedup.WINDOW, 0)))
        want[key(r)[0], r[1], r[2], r[4]] = (step, gone)
    for bound in (50_000, 10):
        monkeypatch.setattr(substring_dedup, "BUCKET_KINDS", bound)
        found = {}
        for r in substring_dedup._grown(table).collect():
            at = (-1 if r.doc_id is None else r.doc_id, r.text_key, r.at, r.is_left)
            step, gone = found.get(at, (0, 0))
            found[at] = (max(step, r.step), max(gone, r.gone or 0))
        assert {k: found.get(k, (0, 0))[0] for k in want} == {k: v[0] for k, v in want.items()}
        # an overlapping lead may hide a later one: never more than brute force, and equal where no copy overlaps
        assert all(found.get(k, (0, 0))[1] <= v[1] for k, v in want.items())
        texts = {}
        for r in rows:
            texts.setdefault((r[0], r[1]), []).append(r[2])
        alone = [k for k in want if len(texts[(None if k[0] == -1 else k[0], k[1])]) == 1]
        assert alone and all(found.get(k, (0, 0))[1] == want[k][1] for k in alone)


def test_recall_by_length(spark):
    """Exact passages in mid-line, 40 of each length: from CERTAIN_WORDS on all are removed, to their last word; shorter ones whole or not at all."""
    rng = random.Random(21)
    lengths = [n for n in (*range(20, 35, 2), 35, 36, 40, 50, 51, 60) for _ in range(40)]
    texts, passages = [], []
    for i, n in enumerate(lengths):
        passage = prose(n, rng)
        for k in range(2):
            texts.append(" ".join([*prose(rng.randrange(15, 40), rng), f"l{i}{k}", *passage, f"r{i}{k}", *prose(rng.randrange(15, 40), rng)]))
        passages.append(" ".join(passage))
    found, hits = gone(spark, texts), {}
    for i, n in enumerate(lengths):
        assert not found[2 * i].any()
        at = texts[2 * i + 1].index(passages[i])
        want = np.zeros(len(texts[2 * i + 1]), bool)
        want[at : at + len(passages[i])] = True
        hit = (found[2 * i + 1] == want).all()
        assert hit or not found[2 * i + 1].any()
        hits[n] = hits.get(n, 0) + int(hit)
    assert all(hits[n] == 40 for n in hits if n >= substring_dedup.CERTAIN_WORDS) and hits[34] >= 36 and hits[20] >= 1


def test_copied_lines_are_found_from_the_least_length_on(spark):
    rng = random.Random(22)
    lines = [" ".join(prose(n, rng)) for n in (20, 21, 25, 30, 34) for _ in range(10)]
    found = gone(spark, [" ".join(prose(30, rng)) + f"\n{line}\n" + " ".join(prose(30, rng)) for line in lines for _ in range(2)])
    assert [int(found[2 * i + 1].sum()) for i in range(len(lines))] == [len(x) for x in lines]
