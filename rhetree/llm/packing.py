"""Packing token sequences by minimum bin slack.

A document's ids are cut into full windows and one remainder. Full windows are sequences
by themselves. Remainders are dealt at random into groups of about GROUP_PIECES; in a
group, each sequence takes the longest piece left and, by a subset-sum dynamic program
over bitsets, the multiset of remaining lengths that fills it best. The multiset is
backtracked as counts per length and used again as often as the counts allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .encoding import SLICE_BYTES, encoder, slices, tidied, tidy, with_end

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
WINDOW = 2048
#: Pieces in a group: at most one sequence or so of a group stays unfilled.
GROUP_PIECES = 16_384
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens.

    Pieces lie side by side; all but the last of a document have `window` ids. A null
    text counts as empty: its only id is the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()  # what tasks of earlier steps have left in this worker
        pieces = encoder(tokenizer, words_only=False)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, lengths = with_end(*pieces.encode(batch.column("text")), end_id)
            ids = ids.astype("<u4")
            many = -(-lengths // window)
            doc = np.repeat(np.arange(len(lengths)), many)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * window
            length = np.minimum(window, lengths[doc] - start)
            at = (np.cumsum(lengths) - lengths)[doc] + start
            sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                    pa.array(sums, pa.int64()),
                    pa.array(lengths[doc].astype(np.int64)),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    slim = docs.select("doc_id", text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidied(cut), f"doc_id {kind}, {PIECES}")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset {length: times} within `counts` whose sum comes closest to `room` from below.

    Bit n of the set is on if some multiset sums to n. Lengths are added from the longest
    in powers of two of their counts, until `room` itself is reached.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & full
            left, part = left - part, part * 2
            if reach >> room & 1:
                left = 0
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def fill_sequences(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each of the given lengths (1 to window) within one group."""
    order = np.argsort(-lengths, kind="stable")
    queues: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        queues.setdefault(int(lengths[i]), []).append(i)
    counts = {x: len(q) for x, q in queues.items()}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = best_fill({k: v for k, v in counts.items() if v}, window - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        for _ in range(min(counts[x] // m for x, m in fill.items())):
            at = 0
            for x in sorted(fill, reverse=True):
                for _ in range(fill[x]):
                    i = queues[x].pop()
                    sequence[i], offset[i] = n, at
                    at += x
                counts[x] -= fill[x]
            n += 1
        counts = {x: c for x, c in counts.items() if c}
    return sequence, offset


def packed(piece_rows: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `window`.

    Groups are dealt by where a row lies in the written table, so that any number of
    equal rows spreads evenly; sequences of different groups have different ids. Columns
    called sequence_id and offset are replaced, all others pass through. An empty table
    gives no row; of pieces of equal length any may come first.
    """
    piece_rows = piece_rows.drop("sequence_id", "offset")
    free = max([0, *map(len, piece_rows.columns)]) * "_"
    place, number = f"{free}place", f"{free}group"
    rows = written(piece_rows, "pieces").select(
        "*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias(place)
    )
    n_groups = max(1, -(-rows.count() // group_pieces))
    keyed = rows.withColumn(number, F.pmod(F.col(place), F.lit(n_groups).cast("long")))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(place, kind="stable")
        sequence, offset = fill_sequences(group["length"].to_numpy(), window)
        group["sequence_id"] = group[number] * (1 << 32) + sequence
        group["offset"] = offset
        return group.drop(columns=[place, number])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_rows.schema.fields)
    return keyed.groupBy(number).applyInPandas(fill, f"{fields}, sequence_id long, offset long")


def packing_digest(docs: DataFrame) -> DataFrame:
    """One row per piece of each document with its place in a sequence.

    A null or empty text is one piece, the end id alone. Repeated rows are packed as
    documents of their own, an empty table has no piece; other columns are not read.
    """
    return packed(pieces(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def padding(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, ids, and pad ids (a sequence is padded to `window` unless a power of two long)."""
    each = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.expr("bit_count(n) = 1"), 0).otherwise(window - F.col("n"))
    return each.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_ids"), F.sum(pad).alias("n_pad"))
