from brindle.llm import jaccard


def test_rows_of_one_id_with_different_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " end"), (2, "a clean and different document"), (2, "a clean and different document"), (3, "alone")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, text), (2, "a clean and different document"), (3, "alone")]
