"""Byte-level BPE by recursive queries.

Words (matches of the splitting pattern) are rows of tokens by position, at first one for
each byte. A recursive DuckDB query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of the lowest rank, until no pair of the word has a
rank. Decoding joins ids with the vocabulary and aggregates the bytes in order.

The queries run inside each Spark task on what that task holds: every distinct word once.

Words of more than LONG bytes (text without blanks, long numbers) would take as many steps
as they have merges. They are first cut where no token of the vocabulary can reach across,
and what stays long contracts all places of its lowest rank in one step. That gives the
same ids if the new token is in no pair of a lower rank. Where it is (`lonely`, looked up in
the file), what follows such a place happens within one token's length of it: places are
contracted together that have no other of their rank within REACH lengths to the left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .encoding import ENCODE_BYTES, PieceEncoder, slices, tidied

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of words that one recursive query starts from.
BYTES_AT_ONCE = 150_000
#: Bytes from which a word counts as long.
LONG = 256
#: Longest tokens between places that cannot bear on each other: one for each of the two.
REACH = 2
#: Nothing is spilled to a local folder.
DUCKDB = {"threads": 1, "memory_limit": "250MB", "max_temp_directory_size": "0KB"}

#: `pos` numbers the tokens of all words in a row; `best` is the lowest rank of a word's
#: pairs, then the leftmost place, in one number. Words without a pair are finished.
PAIRS = """
    SELECT s.word, s.pos, s.tok, s.earlier,
           min(g.merged * 4294967296 + s.pos) OVER (PARTITION BY s.word) AS best
    FROM (SELECT word, pos, tok, lead(tok) OVER w AS following, lead(word) OVER w AS next_word,
                 lag(pos) OVER w AS earlier
          FROM {tokens} WINDOW w AS (ORDER BY pos)) s
    LEFT JOIN merges g ON g.lhs = s.tok AND g.rhs = s.following AND s.word = s.next_word
"""
CONTRACTED = """(
    SELECT word, pos, CASE WHEN pos = best & 4294967295 THEN (best >> 32)::INTEGER ELSE tok END AS tok
    FROM state WHERE best IS NOT NULL AND (earlier IS NULL OR earlier <> best & 4294967295))
"""
CONTRACT = f"""
WITH RECURSIVE state AS ({PAIRS.format(tokens="words")} UNION ALL {PAIRS.format(tokens=CONTRACTED)})
SELECT word, tok FROM state WHERE best IS NULL ORDER BY pos
"""
#: The same for long words, whose lowest rank is contracted wherever it is, from the left:
#: `k` counts places of that rank in a row, and every other one of them is taken; lonely
#: ones (odd ranks) are taken if none lies within $reach bytes before them.
ALL_PAIRS = """
    SELECT *, min(rank) OVER (PARTITION BY word) AS best
    FROM (SELECT s.word, s.pos, s.tok, g.merged * 2 + g.lonely::INTEGER AS rank
          FROM (SELECT word, pos, tok, lead(tok) OVER w AS following, lead(word) OVER w AS next_word
                FROM {tokens} WINDOW w AS (ORDER BY pos)) s
          LEFT JOIN merges g ON g.lhs = s.tok AND g.rhs = s.following AND s.word = s.next_word)
"""
ALL_CONTRACTED = """(
    SELECT word, pos, CASE WHEN taken THEN (best >> 1)::INTEGER ELSE tok END AS tok
    FROM (SELECT word, pos, tok, best, taken, lag(taken) OVER (ORDER BY pos) AS gone
          FROM (SELECT *, coalesce(rank = best, false)
                       AND CASE WHEN best % 2 = 1
                           THEN pos - max(CASE WHEN rank = best THEN pos ELSE -$reach END)
                                      OVER (PARTITION BY word ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= $reach
                                OR row_number() OVER (PARTITION BY word ORDER BY k) = 1
                           ELSE (k - max(CASE WHEN rank = best THEN 0 ELSE k END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) % 2 = 1 END AS taken
                FROM (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM state WHERE best IS NOT NULL)))
    WHERE NOT coalesce(gone, false))
"""
CONTRACT_ALL = f"""
WITH RECURSIVE state AS ({ALL_PAIRS.format(tokens="words")} UNION ALL {ALL_PAIRS.format(tokens=ALL_CONTRACTED)})
SELECT word, tok FROM state WHERE best IS NULL ORDER BY pos
"""
DECODE = """
SELECT string_agg(v.hex, '' ORDER BY r.pos) AS hex
FROM runs r JOIN vocab v ON v.id = r.id GROUP BY r.run ORDER BY r.run
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RecursiveBpe(PieceEncoder):
    """Encodes pieces of text with DuckDB; pieces are remembered as in PieceEncoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.words_only = False
        self.added: list[tuple[str, bool]] = []
        self._forget()
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config=DUCKDB)
        pairs = [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        lonely = {x for a, b, r in pairs for x in (a, b) if x > r}
        self.tokens = list(ranks)
        self.inside = _inside(self.tokens)
        columns = zip(*pairs, strict=True) if pairs else ((), (), ())
        merges = pa.table(dict(zip(("lhs", "rhs", "merged"), (pa.array(c, pa.int64()) for c in columns), strict=True)))
        merges = merges.append_column("lonely", pa.array([r in lonely for *_, r in pairs], pa.bool_()))
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int64()), "hex": [t.hex() for t in ranks]})
        self.db.register("given_merges", merges)
        self.db.register("given_vocab", vocab)
        self.db.execute("CREATE TABLE merges AS SELECT lhs::INTEGER AS lhs, rhs::INTEGER AS rhs, merged, lonely FROM given_merges")
        self.db.execute("CREATE TABLE vocab AS SELECT id::INTEGER AS id, hex FROM given_vocab")
        self.leads = np.zeros(max(ranks.values()) + 1, bool)
        self.leads[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.decoded: dict[bytes, bytes] = {}

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def _words(self, words: list[bytes], sql: str = CONTRACT) -> list[np.ndarray]:
        """The ids of distinct words, by the recursive query."""
        sizes = np.array([len(w) for w in words], np.int64)
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rows = pa.table(
            {
                "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "pos": np.arange(len(tokens)),
                "tok": tokens,
            }
        )
        out = self._query(sql, words=rows)
        word, tok = out.column("word").to_numpy(), out.column("tok").to_numpy()
        return np.split(tok, np.searchsorted(word, np.arange(1, len(words))))

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of a long word: cut where no token reaches across, then by the queries."""
        data = np.frombuffer(word, np.uint8)
        crossed = np.zeros(len(data) - 1, bool)
        for n, known in self.inside.items():
            grams = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                grams = grams << np.uint64(8) | data[k : len(data) - n + 1 + k].astype(np.uint64)
            hit = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams
            for k in range(n - 1):
                crossed[k : k + len(hit)] |= hit
        cuts = [0, *(np.flatnonzero(~crossed) + 1).tolist(), len(word)]
        parts = [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids: dict[bytes, np.ndarray] = {}
        for long in (False, True):
            some = list(dict.fromkeys(p for p in parts if (len(p) > LONG) == long))
            for batch in _batches(some):
                sql = CONTRACT_ALL.replace("$reach", str(REACH * self._longest(batch))) if long else CONTRACT
                ids.update(zip(batch, self._words(batch, sql), strict=True))
        return np.concatenate([ids[p] for p in parts])

    def _longest(self, words: list[bytes]) -> int:
        """Bytes of the longest token that has no other bytes than the words."""
        letters = bytes(set(b"".join(words)))
        return max(len(t) for t in self.tokens if not t.translate(None, letters))

    def _encode(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        ids = self._whole(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, count=len(ids))
        return pieces, np.fromiter(chain.from_iterable(ids), np.uint32, count=int(sizes.sum())), sizes

    def _whole(self, texts: list[str]) -> list[list[int]]:
        cut = [self.split(t) for t in texts]
        distinct = list(dict.fromkeys(w for words in cut for w in words))
        ids: dict[bytes, list[int]] = {}
        coded = {w: w.encode() for w in distinct}
        for batch in _batches([w for w in coded.values() if len(w) <= LONG]):
            ids.update(zip(batch, (x.tolist() for x in self._words(batch)), strict=True))
        ids.update((w, self._long(w).tolist()) for w in coded.values() if len(w) > LONG)
        ids = {w: ids[x] for w, x in coded.items()}
        return [[i for w in words for i in ids[w]] for words in cut]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """The bytes of each text from its ids.

        Ids are cut before tokens that begin with a space; distinct runs between the cuts
        are decoded once, and a text is its runs' bytes in order.
        """
        ends = np.cumsum(lengths)
        opens = self.leads[ids]
        opens[(ends - lengths)[lengths > 0]] = True
        at = np.flatnonzero(opens)
        offsets = np.append(at, len(ids)) * 4
        data = pa.py_buffer(ids.astype("<u4").tobytes())
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), data]
        ).dictionary_encode()
        keys = runs.dictionary.to_pylist()
        if len(self.decoded) > 300_000:
            self.decoded = {}
        new = [k for k in keys if k not in self.decoded]
        for i in range(0, len(new), 50_000):
            self.decoded.update(zip(new[i : i + 50_000], self._runs(new[i : i + 50_000]), strict=True))
        parts = [self.decoded[k] for k in keys]
        index = runs.indices.to_numpy(zero_copy_only=False).tolist()
        cuts = np.searchsorted(at, np.append(0, ends)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield b"".join([parts[i] for i in index[a:b]])

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        sizes = np.array([len(r) // 4 for r in runs], np.int64)
        ids = np.frombuffer(b"".join(runs), "<u4").astype(np.int32)
        rows = pa.table(
            {
                "run": np.repeat(np.arange(len(runs), dtype=np.int32), sizes),
                "pos": np.arange(len(ids), dtype=np.int32),
                "id": ids,
            }
        )
        return [bytes.fromhex(h) for h in self._query(DECODE, runs=rows).column("hex").to_pylist()]


def _batches(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in lists of about BYTES_AT_ONCE bytes."""
    batch, size = [], 0
    for w in words:
        batch.append(w)
        size += len(w)
        if size >= BYTES_AT_ONCE:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _inside(tokens: list[bytes]) -> dict[int, np.ndarray]:
    """By length, sorted: tokens of 2 and 3 bytes, and all runs of 4 bytes within tokens.

    A token that reaches across a place of a text is one of the first, or shows one of the
    last there.
    """
    found = {n: {int.from_bytes(t, "big") for t in tokens if len(t) == n} for n in (2, 3)}
    found[4] = {int.from_bytes(t[i : i + 4], "big") for t in tokens for i in range(len(t) - 3)}
    return {n: np.array(sorted(x), np.uint64) for n, x in found.items() if x}


@lru_cache(maxsize=1)
def coder(name: str) -> RecursiveBpe:
    """The coder of a public rank file; a Python worker keeps it for its next tasks."""
    import public_tokenizers

    return RecursiveBpe(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def _list_of(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def encoded(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids array<int>) of each document; a null or empty text has no ids, a text of any length is encoded whole."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _list_of(*coder(ranks).encode(batch.column("text")))], ["doc_id", "ids"]
            )

    slim = docs.select("doc_id", text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidied(encode), f"doc_id {kind}, ids array<int>")


def _decoded(doc_id: pa.Array, ids: np.ndarray, lengths: np.ndarray, ranks: str) -> pa.RecordBatch:
    flat, ends = ids.astype("<u4"), np.cumsum(lengths).tolist()
    sums = [hashlib.sha256(flat[e - n : e].tobytes()).hexdigest() for e, n in zip(ends, lengths.tolist(), strict=True)]
    texts = pa.array(coder(ranks).decode(flat, lengths), pa.binary())
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(lengths), pa.array(sums, pa.string()), texts], ["doc_id", "n_tokens", "ids_sha256", "decoded"]
    )


def decoded(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded binary) from (doc_id, ids); null ids count as none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                lengths = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                yield _decoded(batch.column("doc_id"), flat, lengths, ranks)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(
        tidied(decode), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded binary"
    )


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """`decoded` of `encoded`, in one pass of one worker: the ids stay in the task that made them."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ENCODE_BYTES):
            yield _decoded(batch.column("doc_id"), *coder(ranks).encode(batch.column("text")), ranks)

    slim = docs.select("doc_id", text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidied(both), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded binary")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """Encodes the documents and decodes the ids: counts and hashes of both.

    A null text counts as empty: no ids, and the hashes of nothing. Repeated rows give
    equal rows, an empty table none; other columns are not read.
    """
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
