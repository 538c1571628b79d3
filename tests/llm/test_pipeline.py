"""The pipeline over a small folder of documents, stage by stage."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rhetree.llm import quality, secrets

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrst") for _ in range(RNG.randrange(3, 9))) for _ in range(3000)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, one too short, a null, an exact and a near copy, a passage that two share, a secret, and a row twice."""
    clean = [" ".join(prose(200)) for _ in range(12)]
    shared = " ".join(prose(70))
    near = clean[0].split()
    near[100] = "changed"
    texts = {i: t for i, t in enumerate(clean)}
    texts |= {20: "too short", 21: None, 22: clean[1], 23: " ".join(near)}
    texts |= {30: " ".join([*prose(60), shared, *prose(60)]), 31: " ".join([*prose(60), shared, *prose(60)])}
    texts[40] = " ".join([*prose(80), "password = hunter2hunter2", *prose(80)])
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()]
    rows.append(rows[5])
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder), texts, shared


def test_stages(spark, corpus, tmp_path):
    folder, texts, shared = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_join", "substring_dedup", "secret_scan", "packing"]
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    kept = {r.doc_id for r in quality.quality_digest(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").collect()}
    ids = lambda name: sorted(r.doc_id for r in after[name])
    assert set(ids("quality_rules")) == kept == set(texts) - {20, 21} and len(ids("quality_rules")) == len(kept) + 1
    # one of each group of copies stays, the one of the smallest doc_id; of the row that is there twice one
    assert ids("near_join") == sorted(kept - {22, 23})
    text = {r.doc_id: r.text for r in after["substring_dedup"]}
    assert ids("substring_dedup") == ids("near_join")
    assert shared in text[30] and shared not in text[31] and text[31].split() == [w for k, w in enumerate(texts[31].split()) if not 60 <= k < 130]
    assert all(text[i] == texts[i] for i in text if i != 31)
    assert all(r.n_chars == len(r.text) for r in after["substring_dedup"])
    last = {r.doc_id: r.text for r in after["secret_scan"]}
    assert last[40] == texts[40].replace("password = hunter2hunter2", "[SECRET]") and all(last[i] == text[i] for i in last if i != 40)
    assert spark.createDataFrame(list(last.items()), "doc_id long, text string").transform(secrets.scan).where("size(secrets) > 0").count() == 0
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in after["packing"]:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(pieces) == set(last)
    for i, own in pieces.items():
        n = len(encoder.encode(last[i], add_special_tokens=False).ids) + 1
        assert sum(k for _, k in own) == n and sorted(own)[0][0] == 0
    fill = {}
    for r in after["packing"]:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fill.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[k for _, k in own[:-1]]]).tolist() and sum(k for _, k in own) <= 2048


def test_run_is_the_last_stage(spark, corpus):
    folder, texts, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.collect()} == set(texts) - {20, 21, 22, 23}
