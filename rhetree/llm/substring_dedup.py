"""Substring dedup by MinHash banding of lines, and by windows of words within them.

Near copies: lines are the paragraphs. Lines whose MinHash bands collide are joined and
verified by their exact Jaccard similarity over five-word shingles; links and equal lines
make classes. The first occurrence of a class, by doc_id and place, stays.

Exact copies anywhere: of all windows of WINDOW words, those whose hash is the least of
WINDOW neighbouring ones are kept (`least_windows`), so that two passages of
2 * WINDOW - 1 equal words share one wherever they stand and whatever their lines. From
the shared windows a match is extended word by word, as far as it is exact; the passage's
ends lie within WINDOW words of a shared window.

What copied lines and windows cover without a gap is a repeated passage if it has at least
MIN_WORDS words; what later occurrences cover is removed. Copied lines are found from that
length on; passages within lines for certain from CERTAIN_WORDS on, shorter ones if they
hold a kept window. Windows short enough to make that certain from MIN_WORDS on would
match in so many common phrases that the tables of matches outgrow their budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import concluded, in_buckets, spread_join, text_of, written
from .components import components, least_labels
from .encoding import release, slices, tidied
from .shingles import MIX, MIX2, SHINGLE, common_counts, least_windows, minhashes, multipliers, shingle_hashes, words_at
from .splicing import spliced

#: Words of a window, and windows in a row of which the least is kept.
WINDOW = 18
#: Words covered in a row from which they count as a repeated passage.
MIN_WORDS = 20
#: Words from which on equal passages always share a kept window, wherever they stand.
CERTAIN_WORDS = 2 * WINDOW - 1
SIMILARITY = 0.8
RECALL = 0.98
#: Distinct lines up to which a band's bucket gives pairs; lines and shingles of a block of a larger one.
SMALL = 64
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Kinds of a window's neighbourhood that are compared in one task.
BUCKET_KINDS = 50_000
SEED = 9
PARAGRAPHS = "at int, n_words int, is_line boolean, start int, end int, pid long, bands array<long>"
OCCURRENCE = ("doc_id", "text_key", "at")


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 2) -> int:
    """The fewest bands of `rows` MinHashes that let a pair of `similarity` collide with chance `recall`."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, at, n_words, is_line, start, end, pid, bands of lines with a word and of kept windows.

    `at` is the place of the first word among the text's words; start and end are code
    points, of lines only; pid is a 64-bit hash of the words. Of equal lines a task works
    on together, only the first has bands.
    """
    rows, n_bands = 2, bands_for()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        factors = multipliers(rows * n_bands, SEED)
        for batch in slices(batches, "text"):
            words, text, line, start, end = words_at(batch.column("text"))
            begins = np.ones(len(words), bool)
            begins[1:] = line[1:] != line[:-1]
            first = np.flatnonzero(begins)
            size = np.diff(np.append(first, len(words)))
            own = np.repeat(np.arange(len(first)), size)
            power = np.ones(int(size.max()) + 1 if len(size) else 1, np.uint64)
            power[1:] = np.cumprod(np.full(len(power) - 1, MIX))
            pid = np.add.reduceat(words * power[np.arange(len(words)) - first[own]], first) if len(first) else np.zeros(0, np.uint64)
            pid = (pid ^ (pid >> np.uint64(32))) * MIX2
            pid ^= pid >> np.uint64(29)
            low = minhashes(*shingle_hashes(words, size), factors).astype(np.uint64)
            band = np.arange(n_bands, dtype=np.uint64) + np.uint64(1)
            bands = ((low[:, ::2] << np.uint64(32)) | low[:, 1::2]) * (MIX + band * np.uint64(2)) + band
            bands ^= bands >> np.uint64(31)
            _, leads = np.unique(pid, return_index=True)
            kept, window = least_windows(words, text, WINDOW)
            many = np.zeros(len(pid) + len(kept), np.int64)
            many[leads] = n_bands
            offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            at = np.concatenate([first, kept])
            take = pa.array(text[at])
            none = np.arange(len(at)) >= len(first)
            last = np.concatenate([first + size - 1, kept])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("text_key").take(take),
                    pa.array((at - np.searchsorted(text, text[at])).astype(np.int32)),
                    pa.array(np.concatenate([size, np.full(len(kept), WINDOW)]).astype(np.int32)),
                    pa.array(~none),
                    pa.array(start[at].astype(np.int32), mask=none),
                    pa.array(end[last].astype(np.int32), mask=none),
                    pa.array(np.concatenate([pid, window]).view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(bands[many[: len(pid)] > 0].ravel().view(np.int64))),
                ],
                ["doc_id", "text_key", "at", "n_words", "is_line", "start", "end", "pid", "bands"],
            )

    slim = docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("text_key"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidied(cut), f"doc_id {kind}, text_key long, {PARAGRAPHS}")


def _row_key(text_key: str = "text_key") -> Column:
    """A hash of doc_id and text_key: copies of a text differ in it, so that they never meet in one task."""
    return F.xxhash64("doc_id", text_key).alias("row_key")


def _sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(pid, shingle hashes) of lines given by (pid, row_key, start, end)."""
    texts = docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("text_key"))
    texts = texts.select("text", _row_key())
    found = in_buckets(texts, places, "row_key").join(places, "row_key")
    # repeated rows give their paragraphs again; only these are shuffled, not the texts
    found = found.select("pid", F.expr("substring(text, start + 1, end - start)").alias("t")).groupBy("pid").agg(F.min("t").alias("t"))
    found = found.select("pid", F.split("t", r"[\x20\x09-\x0D]+").alias("w"))
    whole = F.array(F.xxhash64("w"))
    each = F.expr(f"transform(sequence(1, size(w) - {SHINGLE - 1}), i -> xxhash64(slice(w, i, {SHINGLE})))")
    return found.select("pid", F.array_distinct(F.when(F.size("w") < SHINGLE, whole).otherwise(each)).alias("s"))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block_links(group: pa.Table) -> pa.Table:
    """A forest of the links between two blocks of a bucket (or within one)."""
    ids = group.column("pid").to_numpy()
    lists = group.column("s").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    common = common_counts(lists.flatten().to_numpy(zero_copy_only=False), sizes, len(ids), 0)
    i, j = np.nonzero(np.triu(9 * common >= 4 * (sizes[:, None] + sizes), 1))
    own = least_labels(len(ids), i, j)
    moved = np.flatnonzero(own != np.arange(len(ids)))
    return pa.Table.from_arrays([pa.array(ids[moved]), pa.array(ids[own[moved]])], schema=LINKS)


def paragraph_links(docs: DataFrame, pars: DataFrame) -> DataFrame:
    """(a, b): links between different lines of Jaccard similarity 0.8 or more.

    All pairs of a small bucket are verified once; a large bucket is dealt into blocks,
    whose pairs are verified in tasks that return a forest of the links.
    """
    placed = pars.select("pid", F.explode("bands").alias("band")).repartition("band").groupBy("band", "pid").agg(F.lit(1).alias("one"))
    buckets = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(placed.join(buckets, "band").select("band", "pid", "size"), "colliding")
    small = members.where(F.col("size") <= SMALL)
    other = small.select("band", F.col("pid").alias("b"))
    pairs = small.select("band", F.col("pid").alias("a")).join(other, "band").where("a < b").select("a", "b").distinct()
    wanted = members.select("pid").distinct()
    # only rows with bands: of a line that repeats, one a task slice
    places = pars.where("size(bands) > 0").select("pid", F.struct(_row_key(), "start", "end").alias("at")).join(wanted, "pid")
    places = places.groupBy("pid").agg(F.min("at").alias("at")).select("pid", "at.*")
    sets = written(_sets(docs, written(places, "places")), "paragraph-sets")
    side = lambda x: sets.select(F.col("pid").alias(x), F.col("s").alias(f"s_{x}"))
    common, total = F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b")
    direct = pairs.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * total).select("a", "b")
    large = members.where(F.col("size") > SMALL).select("band", "pid").join(sets, "pid")
    blocks = large.groupBy("band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("s")) / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    )
    dealt = (
        large.join(blocks, "band")
        .withColumn("block", F.pmod(F.xxhash64("pid"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("band", "pid", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "s")
    )
    return direct.unionAll(dealt.groupBy("band", "lo", "hi").applyInArrow(_block_links, "a long, b long"))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated passages: doc_id, text_key, passage, start, end, n_words, class_id, removed.

    A row is a stretch of a passage that is all first occurrences (removed is false) or
    all later ones. class_id names the class of its first line or window; passage numbers
    the passages of a document. Rows equal in doc_id and text are one document. Null and
    empty texts have no paragraph.
    """
    return concluded(lambda: _repeated(docs, min_words), "repeated")


def _copied_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text_key, lo, hi, gone_lo, gone_hi, class_id): words of lines that have copies; gone_ is null in first ones."""
    links = components(paragraph_links(docs, lines), "paragraph-links")
    linked = links.unionAll(links.select(F.col("component").alias("node"), "component")).distinct()
    at = F.struct(*OCCURRENCE)
    kinds = lines.groupBy("pid").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    kinds = kinds.join(linked.withColumnRenamed("node", "pid"), "pid", "left")
    kinds = kinds.where("first <> last OR component IS NOT NULL").withColumn("class_id", F.coalesce("component", "pid"))
    kinds = written(kinds.select("pid", "class_id", "first", "n"), "copied")
    least = kinds.groupBy("class_id").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("n_kinds"))
    kinds = spread_join(kinds.drop("first"), least, "class_id", "n_kinds", kinds.count())
    found = spread_join(lines.drop("bands"), written(kinds, "classed"), "pid", "n", lines.count()).withColumn("removed", ~at.eqNullSafe(F.col("stays")))
    lo, hi = F.col("at"), F.col("at") + F.col("n_words")
    gone = [F.when(F.col("removed"), c) for c in (lo, hi)]
    return found.select("doc_id", "text_key", lo.alias("lo"), hi.alias("hi"), gone[0].alias("gone_lo"), gone[1].alias("gone_hi"), "class_id")


def _later(first: str, words: Column) -> Column:
    """Whether an occurrence of `words` words is not the first one and does not overlap it."""
    same = F.col(f"{first}.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"{first}.text_key") == F.col("text_key"))
    return ~same | (F.col("at") - F.col(f"{first}.at") >= words)


def _copied_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same of windows that have copies, each extended as far as a copy goes on (exactly)."""
    at, slim = F.struct(*OCCURRENCE), windows.select(*OCCURRENCE, "pid")
    ends = slim.groupBy("pid").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    ends = written(ends.where("first <> last").select("pid", "first", "n"), "window-kinds")
    hits = spread_join(slim, ends, "pid", "n", slim.count())
    hits = hits.withColumn("removed", _later("first", F.lit(WINDOW))).drop("first").distinct()
    chain = Window.partitionBy("doc_id", "text_key", "removed").orderBy("at")
    gap = lambda c: F.coalesce(c > WINDOW, F.lit(True))
    hits = hits.withColumns({"left": gap(F.col("at") - F.lag("at").over(chain)), "right": gap(F.lead("at").over(chain) - F.col("at"))})
    hits = written(hits, "copied-windows")
    # all occurrences of a window are extended where one of them ends a chain
    open_ = hits.groupBy("pid").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.count(F.lit(1)).alias("n"))
    open_ = spread_join(hits.select(*OCCURRENCE, "pid"), open_.where("left OR right"), "pid", "n", hits.count())
    open_ = open_.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "pid", "left", "right")).alias("open"))
    grown = _grown(written(_contexts(docs, written(open_, "open")), "contexts"))
    most = lambda left, c: F.max(F.when(F.col("is_left") == left, F.col(c)))
    grown = grown.groupBy(*[F.col(c).alias(f"_{c}") for c in OCCURRENCE]).agg(
        most(True, "step").alias("l"), most(False, "step").alias("r"), most(True, "gone").alias("gone_l"), most(False, "gone").alias("gone_r")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in OCCURRENCE]
    hits = hits.select(*OCCURRENCE, "pid", "removed").join(grown, same, "left")
    lo = lambda c: F.col("at") - F.coalesce(c, F.lit(0))
    hi = lambda c: F.col("at") + WINDOW + F.coalesce(c, F.lit(0))
    return hits.select(
        "doc_id", "text_key", lo("l").alias("lo"), hi("r").alias("hi"), F.when(F.col("removed"), lo("gone_l")).alias("gone_lo"),
        F.when(F.col("removed"), hi("gone_r")).alias("gone_hi"), F.col("pid").alias("class_id"),
    )


def _with_texts(docs: DataFrame, gathered: DataFrame, column: str) -> DataFrame:
    """doc_id, text_key, text and a gathered column of the documents that have it."""
    texts = docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("text_key"))
    own = gathered.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), column, _row_key())
    found = in_buckets(texts.withColumn("row_key", _row_key()), own, "row_key").join(own, "row_key").where("text_key = _k AND doc_id <=> _d")
    return found.select("doc_id", "text_key", "text", column)


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each struct, the structs) of a column of arrays of structs."""
    lists = batch.column(column)
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _contexts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, pid, is_left, near): near has 32-bit hashes of the words beside a window, the nearest first."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            words, text, *_ = words_at(batch.column("text"))
            short = (words >> np.uint64(32)).astype(np.uint32).view(np.int32)
            row, rest = _flat(batch, "open")
            at = rest.field("at").to_numpy(zero_copy_only=False)
            begin, stop = np.searchsorted(text, row), np.searchsorted(text, row, "right")
            for is_left, name in ((True, "left"), (False, "right")):
                own = np.flatnonzero(rest.field(name).to_numpy(zero_copy_only=False))
                steps = np.arange(1, WINDOW)
                place = (begin + at)[own, None] + (-steps if is_left else WINDOW - 1 + steps)
                inside = (place >= begin[own, None]) & (place < stop[own, None])
                offsets = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
                take = pa.array(row[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(at[own].astype(np.int32)),
                        rest.field("pid").take(pa.array(own)), pa.array(np.full(len(own), is_left)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(short[place[inside]])),
                    ],
                    ["doc_id", "text_key", "at", "pid", "is_left", "near"],
                )

    rows = _with_texts(docs, open_, "open")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(look), f"doc_id {kind}, text_key long, at int, pid long, is_left boolean, near array<int>")


LEADS = pa.schema([("kind", pa.int64()), ("step", pa.int32()), ("lead", pa.int64()), ("n", pa.int64())])


def _bucket_leads(group: pa.Table) -> pa.Table:
    """(kind, step, lead, n): the kind that holds the first of all occurrences alike for `step` words, the most words per lead."""
    keys = [("doc_id", "ascending"), ("text_key", "ascending"), ("at", "ascending")]
    group = group.take(pc.sort_indices(group, sort_keys=keys, null_placement="at_start"))
    lists = group.column("near").combine_chunks()
    begin, values = lists.offsets.to_numpy()[:-1], lists.values.to_numpy(zero_copy_only=False)
    size, n = np.diff(lists.offsets.to_numpy()), group.column("n").to_numpy()
    prefix = group.column("beside").to_numpy().view(np.uint64).copy()
    live, found = np.arange(len(size)), []
    for step in range(1, WINDOW):
        live = live[size[live] >= step]
        if not len(live):
            break
        prefix[live] = (prefix[live] ^ values[begin[live] + step - 1].view(np.uint32)) * MIX
        prefix[live] ^= prefix[live] >> np.uint64(31)
        # rows are in order of their first occurrence, so that the first of a prefix leads
        _, lead, own = np.unique(prefix[live], return_index=True, return_inverse=True)
        lead, more = live[lead][own], np.bincount(own, n[live])[own] > 1
        live = live[more]
        found.append(np.stack([live, np.full(len(live), step), lead[more]]))
    row, step, lead = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((step, row))
    row, step, lead = row[order], step[order], lead[order]
    last = np.ones(len(row), bool)
    last[:-1] = (row[1:] != row[:-1]) | (lead[1:] != lead[:-1])
    kind = group.column("kind").to_numpy()
    columns = [kind[row[last]], step[last].astype(np.int32), kind[lead[last]], n[row[last]]]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=LEADS)


def _kind_leads(kinds: DataFrame) -> DataFrame:
    """The same for kinds whose neighbouring word holds too many of them for a task: a row per prefix."""
    each = kinds.select("kind", "n", F.struct(*OCCURRENCE, "kind").alias("first"), "near", "beside", F.explode(F.sequence(F.lit(1), F.size("near"))).alias("step"))
    each = written(each.select("kind", "n", "first", "step", F.xxhash64("beside", F.slice("near", F.lit(1), F.col("step"))).alias("key")), "prefixes")
    leads = each.groupBy("key").agg(F.min("first").alias("lead"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("rows")).where("all > 1")
    both = spread_join(each.drop("first"), leads.select("key", F.col("lead.kind").alias("lead"), "rows"), "key", "rows", each.count())
    return both.select("kind", F.col("step").cast("int"), "lead", "n")


def _grown(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, is_left, step, gone): words by which a window and another go on alike; gone if that one is earlier.

    Occurrences of a window with the same words beside it are one kind. Kinds that begin
    with the same word are compared in one task, in buckets of about BUCKET_KINDS; those of
    a word with more than that by a row per prefix. Of all that share a prefix the first
    one leads: a kind has a row per lead.
    """
    at = F.struct(*OCCURRENCE)
    rows = rows.where("size(near) > 0").withColumn("kind", F.xxhash64("pid", "is_left", "near"))
    first = F.min(F.struct(*OCCURRENCE, F.xxhash64("pid", "is_left", F.slice("near", 1, 1)).alias("beside"), "near"))
    kinds = rows.groupBy("kind").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = written(kinds.select("kind", "n", "first.*"), "kinds")
    hot = kinds.groupBy("beside").count().where(F.col("count") > BUCKET_KINDS).select("beside")
    n_buckets = kinds.count() // BUCKET_KINDS + 1
    near = in_buckets(kinds, hot, "beside", "left_anti").withColumn("bucket", F.pmod("beside", F.lit(n_buckets)))
    rest = in_buckets(kinds, hot, "beside")
    leads = written(near.groupBy("bucket").applyInArrow(_bucket_leads, "kind long, step int, lead long, n long").unionAll(_kind_leads(rest)), "leads")
    # the lead's place is looked up by its kind
    places = kinds.select(F.col("kind").alias("lead"), F.struct(*OCCURRENCE).alias("first"))
    followers = leads.groupBy("lead").agg(F.count(F.lit(1)).alias("followers"))
    leads = spread_join(leads, places.join(followers, "lead"), "lead", "followers", leads.count())
    both = spread_join(rows.select(*OCCURRENCE, "is_left", "kind"), written(leads.drop("lead"), "led"), "kind", "n", rows.count())
    # a passage is not removed for a copy that it overlaps
    apart = F.greatest(F.col("at") - F.col("first.at") - WINDOW, F.lit(0))
    gone = F.when(_later("first", F.col("step") + WINDOW), F.col("step")).otherwise(F.least("step", apart))
    return both.select(*OCCURRENCE, "is_left", "step", F.when(~at.eqNullSafe(F.col("first")), gone).alias("gone"))


def _stretches(docs: DataFrame, covers: DataFrame, min_words: int) -> DataFrame:
    """Stretches of passages from what copies cover in each document."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            words, text, _, start, end = words_at(batch.column("text"))
            row, rest = _flat(batch, "covers")
            n, begin = len(words), np.searchsorted(text, row)
            lo, hi, gone_lo, gone_hi = (rest.field(c).fill_null(-1).to_numpy(zero_copy_only=False) + begin for c in ("lo", "hi", "gone_lo", "gone_hi"))
            is_gone = rest.field("gone_lo").is_valid().to_numpy(zero_copy_only=False)
            over = lambda a, b: np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0
            copied, removed = over(lo, hi), over(gone_lo[is_gone], gone_hi[is_gone])
            # 0: no copy, 1: first occurrences, 2: later ones
            state = np.where(removed, 2, np.where(copied, 1, 0))
            new_text = np.ones(n, bool)
            new_text[1:] = text[1:] != text[:-1]
            turn, shift = new_text.copy(), new_text.copy()
            turn[1:] |= (state[1:] > 0) != (state[:-1] > 0)
            shift[1:] |= state[1:] != state[:-1]
            passage = np.cumsum(turn) - 1
            long = np.bincount(passage, state > 0) >= min_words if n else np.zeros(0, bool)
            at = np.flatnonzero(shift)
            size = np.diff(np.append(at, n))
            keep = long[passage[at]] & (state[at] > 0)
            at, size = at[keep], size[keep]
            # the class of the first line or window that covers a stretch's first word
            label = np.zeros(len(at), np.int64)
            ids = rest.field("class_id").to_numpy(zero_copy_only=False)
            for gone, a, b in ((1, lo, hi), (2, gone_lo, gone_hi)):
                some = np.flatnonzero(is_gone) if gone == 2 else np.arange(len(lo))
                some = some[np.lexsort((ids[some], a[some]))]
                mine = np.flatnonzero(state[at] == gone)
                reach = np.maximum.accumulate(b[some]) if len(some) else b[some]
                label[mine] = ids[some[np.searchsorted(reach, at[mine], "right")]]
            take = pa.array(text[at])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take), batch.column("text_key").take(take),
                    pa.array((passage[at] - passage[np.searchsorted(text, text[at])]).astype(np.int32)), pa.array(state[at] == 2),
                    pa.array(start[at].astype(np.int64)), pa.array(end[at + size - 1].astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(label),
                ],
                ["doc_id", "text_key", "passage", "removed", "start", "end", "n_words", "class_id"],
            )

    rows = _with_texts(docs, covers, "covers")
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = "text_key long, passage int, removed boolean, start long, end long, n_words long, class_id long"
    return rows.mapInArrow(tidied(merge), f"doc_id {kind}, {kinds}").distinct()


def _repeated(docs: DataFrame, min_words: int) -> DataFrame:
    pars = written(paragraphs(docs), "paragraphs")
    lines = _copied_lines(docs, pars.where("is_line"))
    covers = lines.unionByName(_copied_windows(docs, pars.where("NOT is_line")))
    covers = covers.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi", "gone_lo", "gone_hi", "class_id")).alias("covers"))
    return _stretches(docs, written(covers, "covers"), min_words)


def substring_digest(docs: DataFrame) -> DataFrame:
    """The stretches of repeated passages, one row each; documents without one have no row."""
    return repeated(docs).select("doc_id", "start", "end", "n_words", "class_id", "removed")


def substring_filter(docs: DataFrame) -> DataFrame:
    """The documents without the removed stretches; columns unchanged, n_chars follows the text."""
    gone = repeated(docs).where("removed").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("spans")
    )
    gone = written(gone.select(_row_key(), F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "spans"), "removed")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text",
        F.xxhash64("text").alias("text_key"),
    ).withColumn("row_key", _row_key())
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    rest = in_buckets(whole, gone, "row_key", "left_anti").select(*columns)
    hit = in_buckets(whole, gone, "row_key").join(gone, "row_key", "left")
    # a clash of keys is no hit
    hit = hit.withColumn("spans", F.when(F.col("text_key").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), F.col("spans")))
    new_text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("spans")))
    hit = hit.withColumn("_new", new_text)
    new = {"text": F.col("_new").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("_new").cast(kind)).alias("n_chars")
    return rest.unionAll(hit.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns]))
