"""Readers and writers on small files made here."""

import pytest
from pyspark.sql import functions as F

from rhetree.sources import annotations as A
from rhetree.sources import conll
from rhetree.sources import files as S

UNITS = 'd1_e1\tanybody want sheep?\td1\td1_s1\t0\t20\n\nd1_e2\t"say ""no"""\td1\td1_s2\t21\t30\nd2_e1\tyes\td2\td2_s1\t0\t3\n'
PAIRS = "ROOT\td1_e1\nd1_e1\td1_e2\td1\nd1_e2\td1_e2\nROOT\td2_e1\n"
FEATURES = "# labels: elaboration UNRELATED ROOT\n3 1:1 2:0.5\n1 2:2\n2\n3 1:1\n"


@pytest.fixture
def corpus(tmp_path):
    for name, text in {"units": UNITS, "pairs": PAIRS, "features": FEATURES, "vocab": "len\t1\nsame\t2\n"}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_units(spark, corpus):
    rows = {r.id: r for r in S.read_units(spark, str(corpus / "units")).collect()}
    assert set(rows) == {"d1_e1", "d1_e2", "d2_e1"}
    assert rows["d1_e2"].text == 'say "no"' and rows["d1_e2"].span_end == 30
    (corpus / "bad").write_text("a\tb\tc\td\t1\tx\n")
    with pytest.raises(ValueError):
        S.read_units(spark, str(corpus / "bad"))


def test_corpus(spark, corpus):
    paths = [str(corpus / x) for x in ("units", "pairs", "features", "vocab")]
    _, pairs, labels = S.load_corpus(spark, *paths)
    assert labels == ["__UNK__", "elaboration", "UNRELATED", "ROOT"]
    rows = {r.pair_ix: r for r in pairs.collect()}
    assert [rows[i].target for i in range(4)] == [3, 1, 2, 3]
    assert rows[2].parent == rows[2].child == "d1_e2", "self pairs stay"
    assert rows[0].features.toArray().tolist() == [1.0, 0.5] and rows[2].features.toArray().tolist() == [0.0, 0.0]
    assert rows[0].grouping == "d1" and rows[0].psub is None
    (corpus / "pairs").write_text(PAIRS.replace("ROOT\td2_e1", "nobody\td2_e1"))
    with pytest.raises(ValueError, match="nobody"):
        S.load_corpus(spark, *paths)


def test_predictions_and_folds(spark, tmp_path):
    rows = spark.createDataFrame([("g", 0, "a", "b", "x"), ("g", 1, "b", "a", "UNRELATED")], "grouping string, pair_ix long, parent string, child string, label string")
    S.write_predictions(rows, str(tmp_path / "p"))
    assert {tuple(r) for r in S.read_predictions(spark, str(tmp_path / "p")).collect()} == {("a", "b", "x"), ("b", "a", "UNRELATED")}
    folds = spark.createDataFrame([("a", 0), ("b", 1)], "grouping string, fold int")
    S.write_folds(folds, str(tmp_path / "f"))
    assert {tuple(r) for r in S.read_folds(spark, str(tmp_path / "f")).collect()} == {("a", 0), ("b", 1)}


def test_feature_maps(spark, tmp_path):
    (tmp_path / "a").write_text("C#n=1 D#x=a=b c#class=True\n\nC#n=2\n")
    rows = [r.feats for r in S.read_feature_maps(spark, str(tmp_path / "a")).orderBy("instance_id").collect()]
    assert rows == [{"C#n": "1", "D#x": "a=b", "c#class": "True"}, {"C#n": "2"}]
    (tmp_path / "b").write_text("a=1 b=2 c=3 d=4 e=5 f=6 g=7 lost i=9\n")
    assert S.read_feature_maps(spark, str(tmp_path / "b"), restore="c#class").first().feats["c#class"] == "lost"


def test_gazetteer(spark, tmp_path):
    (tmp_path / "verb.lst").write_text("% comment\ndire:type=say:val=1\ndire:type=tell:val=2\n#x\nvoir\n")
    rows = {r.form: r for r in S.read_gazetteer(spark, str(tmp_path / "verb.lst")).collect()}
    assert rows["dire"].minor_type == "tell" and rows["dire"].major_type == "verb" and rows["voir"].val is None


def test_conll(spark, tmp_path):
    row = "\t".join(str(i) for i in range(10))
    (tmp_path / "c").write_text(f"{row}\n{row}\n\n{row}\n1 2\n")
    rows = conll.read_conll(spark, str(tmp_path / "c"))
    assert [(r.sent_ix, r.tok_ix, len(r.cols)) for r in rows.orderBy("sent_ix", "tok_ix").collect()] == [(0, 0, 10), (0, 1, 10), (1, 0, 10), (1, 1, 2)]
    assert conll.check_conll(rows).first().n_bad == 1


def test_native_annotations(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<doc><text>Hello there</text><EDU id="1" start="0" end="5"/><EDU id="2" start="6" end="11"/>'
        "<CS id=\"c\"><member>1</member><member>2</member></CS><rel><from>1</from><to>2</to><type>elab</type></rel></doc>"
    )
    t = A.read_annotations(spark, str(tmp_path / "d.xml"))
    assert {(r.doc, r.id, r.span_end) for r in t["units"].collect()} == {("d", "1", 5), ("d", "2", 11)}
    assert t["complex_units"].first().members == ["1", "2"]
    assert tuple(t["relations"].select("arg1", "arg2", "type").first()) == ("1", "2", "elab")


def test_standoff(spark, tmp_path):
    place = lambda a, b: f'<positioning><start><singlePosition index="{a}"/></start><end><singlePosition index="{b}"/></end></positioning>'
    unit = lambda i, t, a, b: f'<unit id="{i}"><characterisation><type>{t}</type></characterisation>{place(a, b)}</unit>'
    terms = '<term id="u1"/><term id="u2"/>'
    (tmp_path / "x.aa").write_text(
        f'<annotations>{unit("u1", "UDE", 0, 5)}{unit("u2", "UDE", 6, 9)}{unit("m", "Connecteur", 6, 9)}'
        f'<relation id="r"><characterisation><type>contrast</type></characterisation><positioning>{terms}</positioning></relation>'
        '<schema id="s"><characterisation><type>CDU</type></characterisation><positioning><embedded-unit id="u1"/><embedded-unit id="u2"/></positioning></schema></annotations>'
    )
    (tmp_path / "x.ac").write_text("Hello\r\nbut")
    t = A.read_standoff(spark, str(tmp_path / "x.aa"), str(tmp_path / "x.ac"))
    assert {r.unit_text for r in A.elementary(t["units"]).collect()} == {"Hello", "but"}
    assert A.read_markers(t["units"]).first().form == "but"
    assert tuple(t["relations"].select("arg1", "arg2", "type").first()) == ("u1", "u2", "contrast")
    assert t["complex_units"].first().members == ["u1", "u2"]


def test_parsed_tokens(spark, tmp_path):
    tok = lambda i, h, d: f'<token><conll ID="{i}" FORM="f{i}" LEMMA="l" CPOSTAG="N" POSTAG="NC" FEATS="g=m|n=s" HEAD="{h}" DEPREL="{d}"/><extent START="0" END="2"/></token>'
    (tmp_path / "p.xml").write_text(f'<doc><mst_parse id="s1">{tok(1, 0, "root")}{tok(2, 1, "obj")}</mst_parse></doc>')
    rows = A.read_parsed_tokens(spark, str(tmp_path / "p.xml"))
    assert {(r.tok_id, r.head, r.feats["g"]) for r in rows.collect()} == {("1", "0", "m"), ("2", "1", "m")}
    (tmp_path / "q.xml").write_text(f'<doc><mst_parse id="s1">{tok(1, 1, "root")}{tok(2, 1, "obj")}</mst_parse></doc>')
    with pytest.raises(ValueError):
        A.read_parsed_tokens(spark, str(tmp_path / "q.xml"))


def test_root_rows(spark, corpus):
    rows = S.with_root(S.read_units(spark, str(corpus / "units")))
    assert rows.where(F.col("id") == "ROOT").count() == 2


def test_line_numbers_over_many_files_and_blocks(spark, tmp_path):
    """Files of all sizes, empty ones among them, read in small blocks: numbers follow the files' names and the lines in them."""
    import random

    rng, want = random.Random(4), []
    for k in range(12):
        lines = [f"{k}-{i} " + "é" * rng.randrange(60) if rng.random() < 0.9 else "#" for i in range(rng.choice([0, 1, 7, 400]))]
        (tmp_path / f"f{k:02}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "4k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.line_no: r.value for r in S.numbered_lines(spark, str(tmp_path)).collect()}
            assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
            kept = {r.line_no: r.value for r in S.numbered_lines(spark, str(tmp_path), F.col("value") != "#").collect()}
            assert [kept[i] for i in range(len(kept))] == [x for x in want if x != "#"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sparse_features(spark, tmp_path):
    (tmp_path / "f").write_text("# labels: a b\n1 2:0.5 900000:3\n2\n0 1:1\n")
    rows = {r.pair_ix: (r.target, r.features) for r in S.read_features(spark, str(tmp_path / "f"), 1_000_000).collect()}
    assert [rows[i][0] for i in range(3)] == [1, 2, 0] and rows[0][1].indices.tolist() == [1, 899_999] and rows[1][1].numNonzeros() == 0 and rows[2][1].size == 1_000_000
    items = {r.pair_ix: [tuple(x) for x in r["items"]] for r in S.read_feature_items(spark, str(tmp_path / "f")).collect()}
    assert items == {0: [(1, 0.5), (899_999, 3.0)], 1: [], 2: [(0, 1.0)]}
    assert S.read_label_list(spark, str(tmp_path / "f")) == ["__UNK__", "a", "b"]
