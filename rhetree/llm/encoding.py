"""Encoding texts with a tokenizer file, a word at a time.

A tokenizer never merges across the blanks it splits at, so a text's ids are those of its
pieces in a row. Pieces repeat: each worker encodes a distinct piece once with the
tokenizers library and lays the ids of all texts out with array operations. It remembers
pieces by two 64-bit hashes each, in sorted arrays, up to REMEMBERED_BYTES. Texts in
which a cut next to a blank would matter are encoded whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once by array operations, and encoded at once.
SLICE_BYTES = 2_000_000
ENCODE_BYTES = 6_000_000
#: Bytes that the pieces take that a worker remembers.
REMEMBERED_BYTES = 80_000_000
#: Pieces joined to one text for the tokenizers library, and such texts given at once.
JOINED = 1000
AT_ONCE = 20


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `size` bytes of text each (a single longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
            tidy()


def tidy() -> None:
    """Returns freed memory to the system: a Python worker lives on beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` on the batches of a task, and `tidy` when it is done."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            tidy()

    return run


class PieceEncoder:
    """Ids of many texts by a tokenizers file.

    `words_only`: the file's tokenizer drops all blanks, so that texts may be cut at any of
    them; otherwise a space belongs to the word after it. Texts that hold a token added
    to the file (in letters of either case) are encoded whole, as the library finds it.
    """

    def __init__(self, path: str, words_only: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words_only = words_only
        self._forget()
        # what may stand between pieces without a change to their ids, and its own id
        marks = ["\u2665", "\u2605", "\u00ae", "\u00a3", "|"] if words_only else ["\n"]
        self.mark = next(m for m in marks if len(self._ids([m])[0]) == 1)
        self.between = f" {self.mark} " if words_only else self.mark
        self.mark_id = self._ids([self.mark])[0][0]

    def _forget(self) -> None:
        # hashes of the pieces in ascending order, a second hash of each, and its place in `first`
        self.keys, self.checks, self.at = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    _whole = _ids

    def _joins(self, piece: str) -> bool:
        """Whether a piece may be joined with others: it has blanks at most as its first space."""
        word = piece if self.words_only else piece.removeprefix(" ")
        if word.isalnum():
            return True
        return self.mark not in word and len(word.split()) == 1 and not (word[0].isspace() or word[-1].isspace())

    def _encode(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in some order, all their ids in a row, and the number of ids of each.

        Pieces are joined with a mark between them that no piece has, and cut at its id.
        """
        joins = [p for p in pieces if self._joins(p)]
        alone = [p for p in pieces if not self._joins(p)] if len(joins) < len(pieces) else []
        texts = [self.between.join(joins[i : i + JOINED]) for i in range(0, len(joins), JOINED)]
        found, sizes = [], []
        for i in range(0, len(texts), AT_ONCE):
            for ids in self._ids(texts[i : i + AT_ONCE]):
                ids = np.array(ids, np.uint32)
                cut = ids == self.mark_id
                at = np.flatnonzero(cut)
                sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
                found.append(ids[~cut])
        for ids in self._ids(alone):
            found.append(np.array(ids, np.uint32))
            sizes.append(np.array([len(ids)]))
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        if len(sizes) != len(pieces):
            raise RuntimeError("the mark between pieces was not found again")
        return joins + alone, np.concatenate([np.zeros(0, np.uint32), *found]), sizes

    def _atoms(self, piece: str) -> list[str]:
        """What a piece may be cut into further: at single line breaks, and before a last comma or full stop."""
        parts = [piece]
        if "\n" in piece and not self.words_only:
            lines = piece.removeprefix(" ").split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                lines[0] = piece[: len(piece) - len(piece.removeprefix(" "))] + lines[0]
                parts = [y for x in lines for y in ("\n", x)][1:]
        out = []
        for x in parts:
            if x[-1:] in (".", ",") and x[-2:-1] < "\u0250" and x[-2:-1].isalpha():
                out += [x[:-1], x[-1]]
            else:
                out.append(x)
        return out

    def _hashes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(hash, pieces), np.int64, count=len(pieces)), np.fromiter(map(xxh3_64_intdigest, pieces), np.uint64, count=len(pieces))

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The places of pieces of these hashes in the remembered ids, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(key), -1)
        last = len(self.keys) - 1
        at = np.minimum(np.searchsorted(self.keys, key), last)
        same = self.keys[at] == key
        # past pieces that share the first hash
        while (clash := same & (self.checks[at] != check) & (at < last)).any():
            at[clash] += 1
            same = self.keys[at] == key
        return np.where(same & (self.checks[at] == check), self.at[at], -1)

    def _keep(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remembers the ids of new pieces by their hashes."""
        n = len(self.first) - 1
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, ids])
        order = np.argsort(key)
        key = np.concatenate([self.keys, key[order]])
        # two sorted runs: merged in one pass
        merged = np.argsort(key, kind="stable")
        self.keys = key[merged]
        self.checks = np.concatenate([self.checks, check[order]])[merged]
        self.at = np.concatenate([self.at, (n + order).astype(np.int32)])[merged]

    def _places(self, pieces: list[str]) -> np.ndarray:
        """The places of distinct pieces in the remembered ids; unknown ones are encoded."""
        if sum(x.nbytes for x in (self.keys, self.checks, self.at, self.first, self.flat)) > REMEMBERED_BYTES:
            self._forget()
        key, check = self._hashes(pieces)
        place = self._find(key, check)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            cuts = [(p,) if p.isalpha() or p[1:].isalpha() else self._atoms(p) for p in new]
            atoms = list(dict.fromkeys(chain.from_iterable(cuts)))
            strange = np.flatnonzero(self._find(*self._hashes(atoms)) < 0).tolist()
            if strange:
                atoms, ids, lengths = self._encode([atoms[i] for i in strange])
                self._keep(*self._hashes(atoms), ids, lengths)
            many = np.fromiter(map(len, cuts), np.int64, count=len(cuts))
            joined = np.flatnonzero(many > 1)
            if len(joined):
                own = self._find(*self._hashes(list(chain.from_iterable(cuts[i] for i in joined.tolist()))))
                sizes, many = self.first[own + 1] - self.first[own], many[joined]
                lengths = np.add.reduceat(sizes, np.cumsum(many) - many)
                at = unknown[joined]
                self._keep(key[at], check[at], self.flat[_ranges(self.first[own], sizes)], lengths)
            place[unknown] = self._find(key[unknown], check[unknown])
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, the number of ids of each text)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.ascii_split_whitespace(texts) if self.words_only else pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends, counts = ends - ends[0], np.diff(ends)
        words = lists.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = np.zeros(0, np.int64)
        for token, anyhow in self.added:
            whole = np.union1d(whole, np.flatnonzero(pc.match_substring(texts, token, ignore_case=anyhow).to_numpy(zero_copy_only=False)))
        if self.words_only:
            place = self._places(distinct)[index]
        else:
            head = np.zeros(len(index), bool)
            head[ends[:-1][counts > 0]] = True
            # a cut is safe between a space and anything but blanks
            size = pc.binary_length(words.dictionary)
            bare = [pc.binary_length(f(words.dictionary)) for f in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace)]
            odd = [pc.or_(pc.not_equal(n, size), pc.equal(size, 0)).to_numpy(zero_copy_only=False) for n in bare]
            if any(x.any() for x in odd):
                unsafe = ~head & odd[0][index]
                unsafe[1:] |= ~head[1:] & odd[1][index[:-1]]
                whole = np.union1d(whole, np.searchsorted(ends, np.flatnonzero(unsafe), "right") - 1)
            # one look-up for both, as it may begin a new memory
            firsts = index[head]
            opening = np.bincount(firsts, minlength=len(distinct))
            used = [np.flatnonzero(opening), np.flatnonzero(np.bincount(index, minlength=len(distinct)) > opening)]
            found = self._places([lead + distinct[u] for own, lead in zip(used, ("", " "), strict=True) for u in own])
            to = np.zeros((2, len(distinct)), np.int64)
            to[0, used[0]], to[1, used[1]] = found[: len(used[0])], found[len(used[0]) :]
            place = to[1][index]
            place[head] = to[0][firsts]
        sizes = (self.first[1:] - self.first[:-1])[place]
        ids = self.flat[_ranges(self.first[:-1][place], sizes)]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        lengths = sums[ends[1:]] - sums[ends[:-1]]
        if len(whole):
            fixed = self._whole(texts.take(pa.array(whole)).to_pylist())
            parts, at = [], np.concatenate([[0], np.cumsum(lengths)])
            last = 0
            for w, new in zip(whole, fixed, strict=True):
                parts += [ids[at[last] : at[w]], np.array(new, np.uint32)]
                last, lengths[w] = w + 1, len(new)
            ids = np.concatenate([*parts, ids[at[last] :]])
        return ids, lengths


@lru_cache(maxsize=1)
def encoder(name: str, words_only: bool) -> PieceEncoder:
    """The encoder of a public tokenizer file; a Python worker keeps it for its next tasks."""
    import public_tokenizers

    return PieceEncoder(public_tokenizers.path(name), words_only)


def release() -> None:
    """Frees what this worker remembers of pieces: for tasks of other operators, which may run in it next."""
    encoder.cache_clear()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0], then the next, all in a row."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kind = np.int32 if max(total, int(starts.max()) + 1) < 1 << 31 else np.int64
    return np.repeat((starts - before).astype(kind), sizes) + np.arange(total, dtype=kind)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds the id `end` after each text."""
    after = np.cumsum(lengths)
    return np.insert(ids, after, end).astype(np.uint32), lengths + 1
