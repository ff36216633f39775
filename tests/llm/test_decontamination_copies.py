"""Many items and many documents of one text: results as for one item, and no row for each pair."""

from larder.llm import decontaminate

N = 60
WORDS = [f"w{i}" for i in range(20)]


def test_equal_items_are_one_set(spark):
    items = [(i, " ".join(WORDS)) for i in range(N)] + [(N, " ".join(WORDS[:15])), (None, " ".join(WORDS)), (N + 1, "other words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x{i} " + " ".join(WORDS)) for i in range(N)] + [(None, None), (N, "nothing here"), (N + 1, "only other words")], "doc_id long, text string")
    windows, members = decontaminate.benchmark_windows(benchmark)
    of_window, ids = decontaminate.item_sets(members)
    assert windows.count() == of_window.count() == 9 and ids.count() == 3
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark, near=True).collect()}
    assert len(got) == N + 3
    for i in range(N):
        assert got[i]["items"] == sorted(map(str, range(N + 1))) and (got[i]["n_words"], got[i]["n_hit"], got[i]["n_near"]) == (21, 20, N + 1)
    for i, items in ((None, []), (N, []), (N + 1, [str(N + 1)])):
        assert got[i]["items"] == items and got[i]["n_near"] == len(items)


def test_items_without_identifier(spark):
    benchmark = spark.createDataFrame([(None, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")
    row = decontaminate.contamination(docs, benchmark, near=True).first()
    assert (row["n_hit"], row["items"], row["n_near"], row["contaminated"]) == (2, [], 0, True)
