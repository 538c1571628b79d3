"""Length alone rejects no document."""

from rhetree.llm import quality


def test_very_long_clean_document_stays(spark):
    text = " ".join(f"word{i}" for i in range(100_001))
    docs = spark.createDataFrame([(1, text), (2, "too few words")], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.quality_digest(docs).collect()}
    assert rows[1].kept and rows[1].failed == quality.mask_of(("many_words",)) and not rows[2].kept
    assert [r.doc_id for r in quality.quality_filter(docs).collect()] == [1]
    assert quality.mask_of("v2") == quality.mask_of("v3") | quality.mask_of(("many_words",))
