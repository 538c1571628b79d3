"""Bloom filter cascades: exact membership in a list, for all keys of a known universe.

Level 1 encodes the listed keys; level 2 the universe's keys that are not listed but pass
level 1; level 3 the listed keys that pass level 2; and so on, until no key passes by
mistake. A key is looked up level by level until one rejects it: a rejection at an even
level means listed, at an odd one not. For a key of the universe that answer is exact, and
no table of keys is needed at the look-up. Keys outside the universe may be taken for
listed ones, at level 1's error rate at most.

Building looks at the universe once or twice, a partition at a time: only keys that pass
level 1 by mistake are shuffled, and every further level halves what is left. Of a level
its bits alone come to the driver, summed up by words of 64 bits; their number is
computed from counts and held against a limit before anything is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes that all levels of a cascade may take; it is sent to every executor.
MOST_BYTES = 64 << 20
#: A level beyond this many means that two keys share both hashes.
MOST_LEVELS = 60
#: Column names of a key's two hashes.
HASHES = ["h1", "h2"]


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key; a null key hashes like none."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("~"), key).alias("h2")]


@dataclass
class Level:
    """A Bloom filter: `n_bits` bits in words of 64, `n_hashes` of them set for a key."""

    n_bits: int
    n_hashes: int
    words: np.ndarray = field(repr=False)


def _mixed(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """A level's own hash of a key, from its two hashes (multiply and xor-shift rounds)."""
    x = h1.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)) * (h2.view(np.uint64) | np.uint64(1))
    for times in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(times)
    return x ^ (x >> np.uint64(32))


def bits_of(h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    """The places (keys by hashes) that keys set in a level's filter."""
    out = np.empty((len(h1), n_hashes), np.int64)
    with np.errstate(over="ignore"):
        for i in range(n_hashes):
            out[:, i] = (_mixed(h1, h2, level * 64 + i) % np.uint64(n_bits)).astype(np.int64)
    return out


@dataclass
class Cascade:
    """The levels of a cascade; none at all means that nothing is listed."""

    levels: list[Level] = field(default_factory=list)

    @property
    def n_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def passes(self, at: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys pass one level."""
        level = self.levels[at]
        ok = np.ones(len(h1), bool)
        with np.errstate(over="ignore"):
            for i in range(level.n_hashes):
                live = np.flatnonzero(ok)
                bit = (_mixed(h1[live], h2[live], at * 64 + i) % np.uint64(level.n_bits)).astype(np.int64)
                ok[live] = (level.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys are listed."""
        listed, live = np.zeros(len(h1), bool), np.arange(len(h1))
        for at in range(len(self.levels)):
            ok = self.passes(at, h1[live], h2[live])
            if at % 2:  # even levels, counted from 1, hold keys that are not listed
                listed[live[~ok]] = True
            live = live[ok]
        # past the last level: what it encodes is true of all that pass it
        listed[live] = len(self.levels) % 2 == 1
        return listed


def _as_level(keys: DataFrame, n: int, at: int, rate: float, room: int) -> Level:
    """The filter of `n` keys (their hashes) as level `at`; its words are OR-ed together by Spark."""
    n_hashes = max(1, round(-math.log2(rate)))
    n_bits = max(64, math.ceil(n * n_hashes / math.log(2)))
    n_words = -(-n_bits // 64)
    if n_words * 8 > room:
        raise ValueError(f"level {at + 1} of the cascade takes {n_words * 8} bytes, over the {room} left")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in HASHES)
            bit = np.unique(bits_of(h1, h2, at, n_bits, n_hashes))
            word, first = np.unique(bit >> 6, return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    # at most n_words rows, each of 16 bytes
    rows = keys.select(*HASHES).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_words, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Level(n_bits, n_hashes, out)


def _passing(keys: DataFrame, cascade: Cascade, at: int) -> DataFrame:
    """Keys that pass one level."""
    sent = keys.sparkSession.sparkContext.broadcast(Cascade(cascade.levels[: at + 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = sent.value.passes(at, *(batch.column(c).to_numpy() for c in HASHES))
            yield batch.filter(pa.array(ok))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade of the keys of `listed` over those of `universe`; both have a string column `key`.

    Listed keys need not be in the universe; repeats and nulls do no harm; an empty list
    or universe is allowed. Raises ValueError where the levels would take over
    `most_bytes` (longer lists are to be dealt out by a hash of the key, a cascade each).
    """
    names = lambda rows: rows.where(F.col(key).isNotNull()).select(key, *hashes(F.col(key)))
    mine = written(listed.select(key).where(F.col(key).isNotNull()).distinct().select(key, *hashes(F.col(key))), "listed")
    n = mine.count()
    if not n:
        return Cascade()
    every = names(universe)
    size = max(1, every.agg(F.approx_count_distinct("h1")).first()[0])
    # the first level's rate that makes all levels together smallest
    rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * n / size))
    out = Cascade([_as_level(mine, n, 0, rate, most_bytes)])
    # of the universe only what passes level 1 is shuffled; a key is there once, and not if it is listed
    wrong = _passing(every, out, 0).withColumn("own", F.lit(False)).unionByName(mine.withColumn("own", F.lit(True)))
    wrong = written(wrong.groupBy(key, *HASHES).agg(F.max("own").alias("own")).where("NOT own").drop("own"), "cascade")
    sides, at = [mine, wrong], 1
    while n := (now := sides[at % 2]).count():
        if at >= MOST_LEVELS:
            raise RuntimeError("two keys share both hashes")
        out.levels.append(_as_level(now, n, at, 0.5, most_bytes - out.n_bytes))
        # those of the other side that pass this level by mistake go into the next one
        sides[(at + 1) % 2] = written(_passing(sides[(at + 1) % 2], out, at), "cascade")
        at += 1
    return out
