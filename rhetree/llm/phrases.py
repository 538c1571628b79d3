"""Phrase collocations from sorted count streams.

Phrases are counted order by order. Of a longer phrase only those places are looked at
where both phrases one word shorter are frequent, since no phrase is more frequent than its
parts. What is frequent is told by a bitmap of hashes of a bounded size: it may let rare
phrases pass, never loses a frequent one, and the counts are of the phrases themselves.

The frequent phrases of all orders then are one table, laid out as streams. In prefix order
(each phrase by its first k words) and in suffix order (by the rest) they are sorted and
merged in lockstep with the table in phrase order, which gives the counts to the left and
to the right of every cut; the streams of phrases less their last and less their first
word give each phrase the count of its most frequent extension. All are sort-merge joins
on keys that are phrases, so no hash table is built and a frequent word's rows may be
split among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import concluded, text_of, written
from .encoding import ENCODE_BYTES, slices, tidied

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of a bitmap per frequent phrase, and at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Parts that a language's phrases are ranked in before the last ranking.
RANK_PARTS = 64
#: What a byte is: 0 a word's, 1 a blank, 2 an end of a piece.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Bytes with A-Z in lower case.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of texts: their numbers in `names`, the piece and the text each is in."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        # not by pc.ascii_lower, which gives wrong offsets for a slice that was cast
        data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        heads = ends[:-1] - ends[0]
        kind = KINDS[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = heads[(heads > 0) & (heads < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(heads, starts, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + self.text
        offsets = np.concatenate([[0], np.cumsum(stops - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        self.names, self.id = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = word_hashes(self.names)[self.id]


def word_hashes(names: pa.Array) -> np.ndarray:
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)


def _phrase_bits(hashes: list[np.ndarray], langs: np.ndarray, n_bits: int) -> np.ndarray:
    """The places in a bitmap of phrases, given the hashes of their words in a row and of their languages."""
    with np.errstate(over="ignore"):
        x = langs
        for h in hashes:
            x = x * STEP + h
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) & np.uint64(n_bits - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def _counts(batch: pa.RecordBatch, order: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of one batch's phrases of `order` words; of order 1 also the number of all words, with a null phrase."""
    words = Words(batch.column("text"))
    langs = batch.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text]
    at = np.arange(max(0, len(words.id) - order + 1))
    at = at[words.piece[at] == words.piece[at + order - 1]]
    if bitmap is not None and len(at):
        n_bits = len(bitmap) * 64
        own = word_hashes(langs.dictionary)[lang]
        for shift in (0, 1):
            parts = [words.hash[at + shift + j] for j in range(order - 1)]
            at = at[_has(bitmap, _phrase_bits(parts, own[at], n_bits))]
    # phrases by number: a pair (phrase one word shorter, word) at a time
    size = max(1, len(words.names))
    key = lang[at]
    for j in range(order):
        key = key * size + words.id[at + j]
        if j and j + 1 < order:
            key = np.unique(key, return_inverse=True)[1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    first = at[first]
    parts = [words.names.take(pa.array(words.id[first + j])) for j in range(order)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if order > 1 else parts[0]
    code = lang[first]
    if order == 1:
        total = np.bincount(lang, minlength=len(langs.dictionary))
        phrase = pa.concat_arrays([phrase, pa.nulls(len(total), pa.large_string())])
        code, n = np.concatenate([code, np.arange(len(total))]), np.concatenate([n, total])
    if len(n):
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(code)).cast(pa.string()), phrase.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"]
        )


def _bitmap(frequent: DataFrame, count: int) -> np.ndarray:
    """The bitmap of frequent phrases of one order: at most MOST_BITS bits, OR-ed together by Spark."""
    n_bits = min(MOST_BITS, 1 << max(10, (count * BITS_EACH).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column("phrase").cast(pa.large_string()), " ")
            hashes = word_hashes(lists.flatten()).reshape(batch.num_rows, -1)
            bit = np.unique(_phrase_bits(list(hashes.T), word_hashes(batch.column("lang")), n_bits))
            word, first = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, phrase, n) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n) of all words.

    A null lang is `und`, a null text empty; repeated documents count again.
    """
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    context, bitmap, tables, totals = docs.sparkSession.sparkContext, None, [], None
    for order in range(1, longest + 1):
        sent = None if bitmap is None else context.broadcast(bitmap)

        def count(batches: Iterator[pa.RecordBatch], order: int = order, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", ENCODE_BYTES):
                yield from _counts(batch, order, sent and sent.value)

        each = slim.mapInArrow(tidied(count), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found = written(each.where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases{order}")
        if order == 1:
            totals, found = found.where("phrase IS NULL").select("lang", "n"), found.where("phrase IS NOT NULL")
        tables.append(found.withColumn("words", F.lit(order)))
        n = found.count()
        if sent:
            sent.destroy()
        if not n or order == longest:
            break
        bitmap = _bitmap(found, n)
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out, totals


def _collocations(docs: DataFrame, least: int, longest: int, top: int) -> DataFrame:
    counted, totals = frequent_phrases(docs, least, longest)
    # the table in phrase order; phrases of one word are no candidates, but parts of some
    table = written(counted.sort("lang", "phrase"), "phrase-order")
    split = F.split("phrase", " ")
    piece = lambda start, n: F.array_join(F.slice(split, start, n), " ")
    phrases = table.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"), "words")
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("_first"), piece(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("_rest"))
    stream = lambda key, n: table.select("lang", F.col("phrase").alias(key), F.col("n").alias(n)).hint("merge")
    both = cuts.join(stream("_first", "l"), ["lang", "_first"]).join(stream("_rest", "r"), ["lang", "_rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.join(totals.withColumnRenamed("n", "total"), "lang")
    # products go up to 38 digits; the quotient is at most 1000 n / a
    up, down = wide("a") * wide("total") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r")
    both = both.withColumns({"_up": up, "_down": down}).withColumn("score", F.expr("cast(_up div _down AS long)"))
    least_cut = F.min(F.struct("score", "cut", "l", "r")).alias("_cut")
    scored = both.groupBy("lang", "phrase", "a", "total").agg(least_cut)
    # extensions by a word at either end; a longer one that is as frequent holds one that is
    longer = phrases.where("words > 2")
    ends = longer.select("lang", piece(F.lit(1), F.col("words") - 1).alias("phrase"), "a").unionAll(
        longer.select("lang", piece(F.lit(2), F.col("words") - 1).alias("phrase"), "a")
    )
    beyond = ends.groupBy("lang", "phrase").agg(F.max("a").alias("_beyond"))
    kept = scored.join(beyond.hint("merge"), ["lang", "phrase"], "left").where("coalesce(_beyond, -1) < a")
    order = [F.col("_cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = kept.withColumn("_part", part)
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("total").alias("n"), F.col("_cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line breaks, and those
    into words at blanks; a phrase is 2 to `longest` words within a piece that occur
    `least` times (a). Its score is floor(1000 a n / (l r)) at the cut that makes it
    least (the first of equal ones): l and r count the parts, n all words of the language.
    Phrases that lie within a longer one as frequent are left out. Order: score, a, then
    the phrase by its bytes. A null lang is `und`, a null text empty, repeated rows count
    again, an empty table gives an empty one; other columns are not read.
    """
    return concluded(lambda: _collocations(docs, least, longest, top), "collocations")


def phrase_digest(docs: DataFrame) -> DataFrame:
    """The first 2000 phrases of each language that occur 100 times; nulls, ties and repeats as in `collocations`."""
    return collocations(docs)
