"""Periodic runs in word sequences, located by block convolution.

A run is a stretch of words with smallest period q, at least 4 q long (and at least 6), that
no neighbouring word extends. At the dyadic scale B, which stands for the periods B to
2 B - 1, the words are cut into blocks of B. A block inside a run recurs q words later,
inside the window of the two blocks that follow it. The sum of squared differences between
a block and every place of its window is a convolution of word numbers, taken by an exact
number-theoretic transform: where the sum is 0 there is no mismatch. Blocks in a row that
recur at one distance seed a run, which is compared word by word and extended to both
sides, a block at most, as a block beyond would have been a seed itself.

Sums are residues of a prime, so a sum of 0 can also be a multiple of it: seeds are more
than the recurrences, never less, and the comparison decides. Short documents are laid
side by side, with marks between them that equal nothing, and go through one transform;
a scale looks only at documents long enough for its periods.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .encoding import SLICE_BYTES, tidy

#: Times the period that a run is long at least, and its least words.
EXPONENT, LEAST = 4, 6
#: Primes, a generator of each, and the power of 2 that divides the prime less 1.
PRIMES = ((786_433, 10, 18), (167_772_161, 3, 25), (3_221_225_473, 5, 30))
#: Numbers that are transformed at once.
AT_ONCE = 1 << 20
#: The largest transform that is one matrix product; longer ones are split into two.
MATRIX = 64
RUN = "array<struct<start:long,length:long,period:long>>"
FOUND = f"runs {RUN}, kept array<struct<start:int,length:int>>"


#: Primes below it: products of residues, even of ones left at the prime itself, stay exact as doubles.
SMALL_PRIME = 1 << 24


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers below 2 ** 53, kept as doubles; under a small prime 0 may stand as the prime itself."""
    q = x * (1.0 / p)
    np.floor(q, out=q)
    q *= p
    np.subtract(x, q, out=q)
    if p > SMALL_PRIME:  # the quotient may have been off by one
        q[q >= p] -= p
        q[q < 0] += p
    return q


def _times(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """Products of residues."""
    if p < SMALL_PRIME:
        return _mod(x * y, p)
    return (x.astype(np.uint64) * y.astype(np.uint64) % np.uint64(p)).astype(np.float64)


@lru_cache(maxsize=64)
def _matrix(n: int, root: int, p: int) -> list[tuple[int, np.ndarray]]:
    """The powers root ** (i k) as an n x n matrix, in digits so small that products of n of them with residues stay exact."""
    powers = np.ones(n, np.uint64)
    for i in range(1, n):
        powers[i] = int(powers[i - 1]) * root % p
    whole = powers[np.outer(np.arange(n), np.arange(n)) % n]
    digit = 52 - p.bit_length() - n.bit_length()
    return [(1 << s, (whole >> np.uint64(s) & np.uint64((1 << digit) - 1)).astype(np.float64)) for s in range(0, p.bit_length(), digit)]


@lru_cache(maxsize=64)
def _twiddles(n: int, m: int, root: int, p: int) -> np.ndarray:
    """root ** (i k) for i < n, k < m."""
    out = np.ones((n, m), np.uint64)
    step, row = np.ones(m, np.uint64), np.ones(m, np.uint64)
    for k in range(1, m):
        step[k] = int(step[k - 1]) * root % p
    for i in range(1, n):
        row = row * step % np.uint64(p)
        out[i] = row
    return out.astype(np.float64)


def ntt(x: np.ndarray, root: int, p: int) -> np.ndarray:
    """The transform of each row: out[k] = sum of x[i] root ** (i k) modulo p; `root` is of the row's order, a power of 2."""
    n = x.shape[-1]
    if n <= MATRIX:
        parts = [_mod(x @ m, p) if scale == 1 else _times(_mod(x @ m, p), np.float64(scale % p), p) for scale, m in _matrix(n, root, p)]
        return parts[0] if len(parts) == 1 else _mod(sum(parts), p)
    a = MATRIX
    b = n // a
    # i = i1 b + i2 and k = k1 + a k2: columns of a, then twiddles, then rows of b
    y = x.reshape(-1, a, b).transpose(0, 2, 1).reshape(-1, a)
    y = ntt(y, pow(root, b, p), p).reshape(-1, b, a)
    y = _times(y, _twiddles(b, a, root, p)[None], p).transpose(0, 2, 1).reshape(-1, b)
    y = ntt(y, pow(root, a, p), p).reshape(-1, a, b)
    return y.transpose(0, 2, 1).reshape(*x.shape[:-1], n)


def recurrences(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) of the places in the two following blocks where a block of `x` recurs, distances from `block` on.

    Found by the sum of squared differences modulo a prime: some may be none.
    """
    size = 2 * block
    p, g, order = next(k for k in PRIMES if size <= 1 << k[2])
    root = pow(g, (p - 1) // size, p)
    back, share = pow(root, p - 2, p), pow(size, p - 2, p)
    m = len(x) // block
    values = np.full((m + 2) * block, p - 1, np.int64)
    values[: m * block] = x[: m * block] % (p - 1)
    tail = min(len(x), (m + 2) * block) - m * block
    values[m * block : m * block + tail] = x[m * block : m * block + tail] % (p - 1)
    found = [], []
    step = max(1, AT_ONCE // size)
    for first in range(0, m, step):
        last = min(m, first + step)
        rows = values[first * block : (last + 2) * block].reshape(-1, block).astype(np.float64)
        squares = (np.cumsum(_times(rows, rows, p).astype(np.uint64), axis=1) % np.uint64(p)).astype(np.float64)
        # a block, then as many zeros; the window is the next block and the one after it, half a turn later
        one = ntt(np.concatenate([rows, np.zeros_like(rows)], axis=1), root, p)
        turn = np.where(np.arange(size) % 2, p - 1.0, 1.0)
        window = _mod(one[1:-1] + _times(one[2:], turn, p), p)
        # correlation: the block's transform taken backwards
        turned = one[:-2][:, (-np.arange(size)) % size]
        cross = _times(ntt(_times(window, turned, p), back, p)[:, :block], np.float64(share), p)
        own, next_, beyond = squares[:-2, -1:], squares[1:-1], squares[2:]
        before = np.concatenate([np.zeros((len(next_), 1)), next_[:, :-1]], axis=1)
        after = np.concatenate([np.zeros((len(beyond), 1)), beyond[:, :-1]], axis=1)
        there = next_[:, -1:] - before + after
        left = _mod(own + there - 2 * cross, p)
        at, shift = np.nonzero((left == 0) | (left == p))
        found[0].append(at + first)
        found[1].append(shift + block)
    return np.concatenate([np.zeros(0, np.int64), *found[0]]), np.concatenate([np.zeros(0, np.int64), *found[1]])


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    edge = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def runs_of(x: np.ndarray, longest: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs of `x`, by start and period.

    `longest` is the length of the longest document in `x`; `lengths` are those of all, in
    falling order as they lie in `x`, each followed by one mark that equals nothing.
    """
    found = np.zeros((0, 3), np.int64)
    ends = np.cumsum(lengths + 1) if lengths is not None else None
    block = 1
    while EXPONENT * block <= longest:
        part = x
        if lengths is not None:
            part = x[: int(ends[np.searchsorted(-lengths, -EXPONENT * block, "right") - 1])]
        at, distance = recurrences(part, block)
        # what lies in a run whose period divides the distance has a smaller period
        if len(at) and len(found):
            live = np.ones(len(at), bool)
            for start, length, period in found[found[:, 1] >= 2 * block].tolist():
                lo, hi = np.searchsorted(at, [-(-start // block), (start + length) // block])
                here = slice(lo, hi)
                live[here] &= (distance[here] % period != 0) | ((at[here] + 1) * block + distance[here] > start + length)
            at, distance = at[live], distance[live]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        new = []
        if len(at):
            # blocks in a row at one distance; a run of period d has so many of them
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(distance) != 0)]))
            count = np.diff(np.append(first, len(at)))
            d = distance[first]
            enough = count >= ((EXPONENT - 1) * d - block + 1) // block
            for s, c, d in zip(at[first][enough].tolist(), count[enough].tolist(), d[enough].tolist(), strict=True):
                lo, hi = max(0, (s - 1) * block), min(len(part) - d, (s + c + 1) * block)
                starts, stops = _stretches(part[lo:hi] == part[lo + d : hi + d])
                good = stops - starts >= max((EXPONENT - 1) * d, LEAST - d)
                new += [(lo + a, b - a + d, d) for a, b in zip(starts[good].tolist(), stops[good].tolist(), strict=True)]
        if new:
            found = np.concatenate([found, np.unique(np.array(new, np.int64), axis=0)])
        block *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _batch(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, runs) of documents whose word numbers are words[offsets[i] : offsets[i + 1]]."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= LEAST]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    lengths, starts = lengths[order], offsets[:-1][order]
    ends = np.cumsum(lengths + 1)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths - 1), lengths + 1)
    at[ends - 1] = 0
    x = words[at]
    x[ends - 1] = int(words.max()) + 1 + np.arange(len(ends))  # the marks
    runs = runs_of(x, int(lengths[0]), lengths)
    own = np.searchsorted(ends, runs[:, 0], "right")
    runs[:, 0] -= (ends - lengths - 1)[own]
    return order[own], runs


def _kept(n: int, runs: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of what is left of n words if each run keeps its first period only."""
    drops = sorted((s + q, s + length) for s, length, q in runs.tolist())
    out, at = [], 0
    for a, b in drops:
        if a > at:
            out.append((at, a - at))
        at = max(at, b)
    return [*out, (at, n - at)] if at < n else out


def _answer(words: pa.Array) -> pa.Array:
    """The runs and what is kept of each list of words."""
    kind = pa.struct(
        [
            ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
            ("kept", pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "length")]))),
        ]
    )
    out, offsets = [], words.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    names = words.flatten()
    bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False) + 1)])[offsets]
    start = 0
    while start < len(words):
        # documents of about SLICE_BYTES, a longer one alone
        stop = max(start + 1, int(np.searchsorted(bytes_, bytes_[start] + SLICE_BYTES, "right")) - 1)
        some = names.slice(offsets[start], offsets[stop] - offsets[start]).dictionary_encode()
        own = offsets[start : stop + 1] - offsets[start]
        docs, runs = _batch(own, some.indices.to_numpy(zero_copy_only=False).astype(np.int64)) if own[-1] else (np.zeros(0, np.int64), np.zeros((0, 3), np.int64))
        by = np.argsort(docs, kind="stable")
        docs, runs = docs[by], runs[by]
        edge = np.searchsorted(docs, np.arange(stop - start + 1))
        for i, n in enumerate(np.diff(own).tolist()):
            mine = runs[edge[i] : edge[i + 1]]
            out.append(
                {
                    "runs": [{"start": s, "length": k, "period": q} for s, k, q in mine.tolist()],
                    "kept": [{"start": s, "length": k} for s, k in _kept(n, mine)],
                }
            )
        start = stop
        tidy()
    return pa.array(out, kind)


def words_of(text: Column) -> Column:
    """The words of a text, split at blanks (space and the characters 9 to 13); a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), lambda w: w != "")


def with_runs(rows: DataFrame, words: str) -> DataFrame:
    """Adds `runs` (start, length, period of all runs of the array column `words`, by start and period) and `kept`, the stretches that remain of it."""
    find = F.arrow_udf(_answer, FOUND)
    return rows.withColumn("_found", find(F.col(words))).withColumns({"runs": F.col("_found.runs"), "kept": F.col("_found.kept")}).drop("_found")


def collapsed(words: str, kept: str = "kept") -> Column:
    """The words that remain, each run reduced to its first period, joined by single spaces."""
    return F.array_join(F.flatten(F.transform(kept, lambda k: F.slice(words, k["start"] + 1, k["length"]))), " ")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """Documents with each run in their texts reduced to its first period; texts without a run stay as they are, character by character.

    A null or empty text stays; repeated rows are treated alike, an empty table gives an
    empty one; other columns, of any name, pass through.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), words_of(F.col("text")).alias("_words"))
    found = with_runs(rows, "_words")
    text = F.when(F.size("runs") == 0, F.col("_row.text")).otherwise(collapsed("_words"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def planted(words: Column, doc_id: Column) -> Column:
    """The words, made periodic from some place on in every tenth document by a checksum of its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
    return F.when((h % 10 == 0) & (n > 0), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i)))).otherwise(words)


def runs_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of each document.

    The four describe the run of greatest length / period (the first of equal ones), null
    without a run. A null or empty text has no words; a null doc_id has no checksum, and
    its words stay. Repeated rows give equal rows, an empty table none.
    """
    rows = docs.select("doc_id", words_of(text_of()).alias("_plain"))
    rows = rows.select("doc_id", F.coalesce(planted(F.col("_plain"), F.col("doc_id")), F.col("_plain")).alias("_words"))
    found = with_runs(rows, "_words")
    # length / period compared exactly, by cross products; the first of equal ones stays
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(lines, F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"), F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(collapsed("_words").cast("binary"), 256).alias("collapsed_sha256"),
    )
