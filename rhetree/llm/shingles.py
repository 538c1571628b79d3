"""Words and shingles of many texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Cells of a 0/1 matrix held at once.
CELLS = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, words of each text); words lie between ASCII blanks."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    index = words.indices.to_numpy(zero_copy_only=False)
    distinct = words.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, count=len(distinct))
    full = np.array([bool(w) for w in distinct], bool)[index]
    before = np.concatenate([[0], np.cumsum(full)])
    return hashes[index][full], np.diff(before[ends - ends[0]])


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, shingles of each text).

    A text of fewer than SHINGLE words, but one at least, has one shingle: all its words.
    """
    first = np.cumsum(counts) - counts
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    many = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), many)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    left = np.minimum(counts[doc], SHINGLE)
    h = left.astype(np.uint64)
    for k in range(SHINGLE):
        w = padded[at + k]
        if (left <= k).any():
            w = np.where(left > k, w, np.uint64(0))
        h = (h ^ w) * MIX
        h ^= h >> np.uint64(32)
    h *= MIX2
    return h ^ (h >> np.uint64(29)), many


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors: minimum of (h * a) >> 32 over a set is one MinHash."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray, many: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash signatures (texts x factors), uint32; rows of texts without shingles are 0."""
    out = np.zeros((len(many), len(factors)), np.uint32)
    some = np.flatnonzero(many)
    if not len(some):
        return out
    first = (np.cumsum(many) - many)[some]
    for k, a in enumerate(factors):
        out[some, k] = np.minimum.reduceat(((shingles * a) >> np.uint64(32)).astype(np.uint32), first)
    return out


def as_sets(shingles: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their number."""
    doc = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], np.bincount(d[new], minlength=len(many))


def common_counts(flat: np.ndarray, sizes: np.ndarray, first: int, shift: int) -> np.ndarray:
    """How many members the sets 0 .. first - 1 share with the sets shift, shift + 1, ...

    `flat` holds the sets in a row. Members of all sets are counted at once, those of one
    set not at all; the others are multiplied as 0/1 columns, CELLS of them at a time.
    """
    n = len(sizes)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.full((first, n - shift), np.float32((often == n).sum()) if n > 1 else 0, np.float32)
    partial = (often > 1) & (often < n)
    number = np.cumsum(partial) - 1
    keep = partial[column]
    row, column = np.repeat(np.arange(n, dtype=np.int32), sizes)[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width, many = max(1, CELLS // n), int(partial.sum())
    for at in range(0, many, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        hot = np.zeros((n, min(width, many - at)), np.float32)
        hot[row[lo:hi], column[lo:hi] - at] = 1
        out += hot[:first] @ hot[shift:].T
    return out


def words_at(texts: pa.Array):
    """Words of texts with their places: (hash, text, line, start, end), an array each.

    Words lie between ASCII blanks; `line` numbers the lines of all texts in a row;
    start and end are code points in the word's text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = ((data >= 9) & (data <= 13)) | (data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    full = ~blank
    before = np.concatenate([[False], full[:-1]]) if len(full) else full
    first = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.concatenate([full[1:], [False]]) if len(full) else full
    last = np.flatnonzero(full & (~after | edge[1:])) + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(offsets, first, "right") - 1
    line = np.cumsum((data == 10) | edge[:-1])[first] if len(first) else np.zeros(0, np.int64)
    sizes = last - first
    # polynomial hash of each word's bytes
    power = np.ones(int(sizes.max()) + 1 if len(sizes) else 1, np.uint64)
    power[1:] = np.cumprod(np.full(len(power) - 1, MIX))
    at = np.flatnonzero(full)
    own = np.repeat(np.arange(len(first)), sizes)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * power[at - first[own]]
    h = np.add.reduceat(terms, np.cumsum(sizes) - sizes) if len(first) else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * MIX2
    h ^= h >> np.uint64(29)
    return h, text, line, chars[first] - chars[offsets[text]], chars[last] - chars[offsets[text]]


def least_windows(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of windows of `size` words that are the least of `size` windows in a row.

    Of equal ones the first is the least. Whether a window is kept depends on the words
    around it alone, so 2 * size - 1 equal words have a kept window in common wherever
    they stand; windows do not leave their text.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * MIX + words[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * MIX2
    h ^= h >> np.uint64(29)
    whole = text[:n] == text[size - 1 :]
    text = np.where(whole, text[:n], -1 - np.arange(n))
    least = np.where(whole, 1, 0).astype(np.int16)
    for forward in (True, False):
        on = whole.copy()
        for k in range(1, min(size, n)):
            near, far = (slice(0, n - k), slice(k, n)) if forward else (slice(k, n), slice(0, n - k))
            more = h[far] >= h[near] if forward else h[far] > h[near]
            on[near] &= more & (text[far] == text[near])
            on[n - k :] = on[n - k :] & (not forward)
            on[:k] = on[:k] & forward
            least += on
    at = np.flatnonzero(least >= size)
    return at, h[at]
