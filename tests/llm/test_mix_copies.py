from colsense.llm import mixing


def test_documents_without_words_are_not_taken_more_often(spark):
    rows = [(i, "a", "one two") for i in range(20)] + [(100 + i, "a", " ") for i in range(60)] + [(200, "b", "x " * 400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(5.0, 1.0)).collect()
    assert max(r.copies for r in out) == 2
    assert sum(r.taken for r in out if r.doc_id < 100) == 80
