"""Single texts of a million characters and more, beside short ones."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rhetree.llm import language_id, near_join, packing, secrets, splicing, substring_dedup, token_files

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(5000)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(200_000))


@pytest.fixture(scope="module")
def docs(spark):
    changed = LONG.split()
    changed[70_000] = "otherwise"
    rows = [(1, LONG, "en"), (2, " ".join(changed), "en"), (3, "a short text", "en"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_near_copies(docs):
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_digest(docs).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_substrings(docs):
    rows = substring_dedup.substring_digest(docs).where("removed").collect()
    assert {r.doc_id for r in rows} == {2} and sum(r.n_words for r in rows) >= 199_999


def test_tokens(docs):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    pieces = packing.packing_digest(docs).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in n} == n
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r.doc_id: len(words.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_files.token_file_digest(docs).collect()} == n


def test_language(docs):
    assert {r.doc_id: r.lang_pred for r in language_id.language_digest(docs).collect()}[4] == "und"


def test_redaction_is_linear(spark):
    """16,000 secrets in one text: every one goes, in little more time than it takes to find them."""
    text = "".join(f"password = hunter2{i:05} and more words of text\n" for i in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.redact(docs.limit(0)).collect()
    began = time.time()
    assert secrets.secrets_digest(docs).first().n_assign == 16_000
    found = time.time() - began
    began = time.time()
    out = secrets.redact(docs).first().text
    assert out == "[SECRET] and more words of text\n" * 16_000
    assert time.time() - began < 2 * found + 5


def test_splicing(spark):
    rows = []
    for i in range(200):
        n = RNG.choice([0, 1, 5, 255, 256, 257, 512, 700, 3000])
        spans = sorted((a := RNG.randrange(n + 1), min(n, a + RNG.choice([0, 1, 3, 100, 600]))) for _ in range(RNG.choice([0, 1, 3, 20, 600])))
        rows.append((i, "".join(RNG.choice("aé😀\n ") for _ in range(n)), spans))
    frame = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int>>")
    got = {r.i: r.x for r in frame.select("i", splicing.spliced(F.col("text"), F.col("spans"), "#").alias("x")).collect()}
    for i, text, spans in rows:
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], "#"]
            at = max(at, b)
        assert got[i] == "".join(out) + text[at:]


def test_packing_encodes_small_slices(spark, monkeypatch):
    """Texts are encoded SLICE_BYTES at a time: the worker of a late stage lives beside a grown JVM."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from rhetree.llm import packing
    from rhetree.llm.encoding import SLICE_BYTES

    class Frame:
        schema = StructType().add("doc_id", "long")
        select = lambda self, *_: self
        mapInArrow = lambda self, work, _: work

    class Encoder:
        seen = []

        def encode(self, texts):
            self.seen.append(sum(map(len, texts.to_pylist())))
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)

    monkeypatch.setattr(packing, "encoder", lambda *_, **__: Encoder())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(70)), "text": ["x" * 100_000] * 70})
    rows = sum(b.num_rows for b in packing.pieces(Frame())(iter([batch])))
    assert rows == 70 and sum(Encoder.seen) == 7_000_000 and max(Encoder.seen) <= SLICE_BYTES
