"""Document frequencies of shingles are exact, however rare they are among all documents."""

from larder.llm import near_dedup


def test_rare_template_weighs_less_than_private_text(spark):
    def word(*x):
        return "w" + "x".join(map(str, x))

    template = [word("t", i) for i in range(104)]
    texts = [" ".join(template + [word("p", k, i) for i in range(12)]) for k in range(5)]
    texts += [" ".join(word("f", k, i) for i in range(6)) for k in range(2995)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # 100 shingles in 5 of 3,000 documents, 12 private ones: 100 / 124 without frequencies, 0.77 with them.
    got = near_dedup.near_duplicates(docs).where("doc_id < 5").collect()
    assert len(got) == 5 and all(r["class_size"] == 1 for r in got)
    texts[1] = " ".join(template + [word("p", 0, i) for i in range(11)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(docs).where("doc_id < 5").collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1)}
