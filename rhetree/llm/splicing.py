"""Cutting spans out of a text in one pass, as column expressions.

A text is split once into chunks of CHUNK characters. What lies between two spans is put
together from at most two parts of chunks and the whole chunks in between, and all
pieces are joined at the end: the time grows with the text and with the number of spans,
not with their product, and nothing that was put together is copied again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a chunk, and spans of a block whose furthest end is summed up.
CHUNK, BLOCK = 256, 256


def _bound(value: Column, use) -> Column:
    """`use` of a value that is computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from `start` to before `end`."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head = F.coalesce(F.get(chunks, a), F.lit(""))
    tail = F.coalesce(F.get(chunks, b), F.lit(""))
    across = F.concat(
        F.substring(head, start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), end % CHUNK)
    )
    return F.when(end <= start, F.lit("")).when(a == b, F.substring(head, start % CHUNK + 1, end - start)).otherwise(across)


def spliced(text: Column, spans: Column, mark: str = "") -> Column:
    """The text with `mark` for every span (start, end in code points, by start); spans that overlap become one.

    Spans are an array of structs that is not null; spans beyond the text's end are cut there.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    zero = F.lit(0)
    most = lambda part: F.aggregate(part, zero, lambda x, s: F.greatest(x, s["end"]))
    # furthest end within each block of spans, then before it
    n_blocks = F.ceil(F.size(spans) / BLOCK).cast("int")
    own = F.transform(F.sequence(zero, n_blocks), lambda k: most(F.slice(spans, k * BLOCK + 1, F.lit(BLOCK))))
    before = lambda blocks: F.transform(blocks, lambda _, k: F.aggregate(F.slice(blocks, F.lit(1), k), zero, lambda x, y: F.greatest(x, y)))

    def pieces(v: Column) -> Column:
        c, ends = v["chunks"], v["ends"]
        reach = lambda i: F.greatest(F.get(ends, F.floor(i / BLOCK).cast("int")), most(F.slice(spans, i - i % BLOCK + 1, i % BLOCK)))
        one = lambda at, s: F.when(s["start"] >= at, F.concat(_between(c, at, s["start"]), F.lit(mark))).otherwise(F.lit(""))
        each = F.transform(spans, lambda s, i: _bound(reach(i), lambda at: one(at, s)))
        last = F.aggregate(ends, zero, lambda x, y: F.greatest(x, y))
        rest = _bound(F.greatest(last, most(F.slice(spans, F.greatest(F.size(spans) - BLOCK, zero) + 1, F.lit(BLOCK)))), lambda at: _between(c, at, F.length(text)))
        return F.concat(F.array_join(each, ""), rest)

    blocks = _bound(own, before)
    return F.when(F.size(spans) == 0, text).otherwise(_bound(F.struct(chunks.alias("chunks"), blocks.alias("ends")), pieces))
