"""Plans and results that must hold as the tables grow."""

from conftest import DATA

from larder.operators import findings, rules, submission, uploads
from larder.plans import intake, reading, stores
from larder.sources import blobs, views
from larder.sources.sinks import send


def test_long_rules_stay_out_of_generated_methods(spark):
    """A rule's columns are made by a node of their own, outside whole-stage methods that the JVM would not compile."""
    rows = spark.range(8).selectExpr("id AS upload", "CAST(id AS INT) AS line", "'beef' AS product", "'1/2/2005' AS date", "'3' AS weight")
    plan = rules.read_cells(rows, "2011-12-31 12:00:00")._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.splitlines() if "Generate inline" in x]
    assert len(made) == 4 and not [x for x in made if "*(" in x]


def test_order_reads_rows_once(spark):
    rows = spark.range(8).selectExpr("id AS upload", "CAST(id AS INT) AS line", "'beef' AS product", "'1/2/2005' AS date", "'3' AS weight")
    plan = rules.decide_order(rules.read_cells(rows, "2011-12-31 12:00:00"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == 4 and "Join" not in plan


def test_parts_are_never_broadcast(spark):
    plan = views.view(spark, "/root/testdata/sf0.001", "cells")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_headers_in_odd_spelling_are_still_found(spark):
    texts = ["PRODUCT\u00a0NAME;Date__Ordered;\ufeffWeight\na;2005-01-01;3\n", "a,b\n\n\"item\nname\"|order-date|weight\nx|2005-01-01|3\n", "produ\u212at|date|weight\n"]
    files = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "upload long, gate string, text string")
    got = {r.upload: (r.delimiter, r.header_line, r.layout_fault) for r in uploads.find_layout(files).collect()}
    assert got == {0: (";", 1, None), 1: ("|", 3, None), 2: (None, None, "bad-header")}


def test_packed_objects_take_no_file_each(spark, tmp_path):
    at = str(tmp_path)
    rows = spark.range(500).selectExpr("concat('a/', id % 3, '/', id) AS key", "encode(repeat('x', CAST(id AS INT)), 'UTF-8') AS content")
    blobs.pack_objects(rows, at)
    blobs.put_objects(spark.createDataFrame([("a/1/1", b"new"), ("a/1/large", b"y" * 900)], "key string, content binary"), at)
    blobs.pack_objects(spark.createDataFrame([("a/2/2", b"newer"), ("b", None)], "key string, content binary"), at)
    assert len([p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]) < 30
    want = {f"a/{i % 3}/{i}": i for i in range(500)} | {"a/1/1": 3, "a/1/large": 900, "a/2/2": 5, "b": 0}
    for prefix in ("", "a/1", "a/1/", "a/1/4", "none"):
        got = [(r.key, r.size) for r in blobs.list_objects(spark, at, prefix).collect()]
        assert sorted(got) == sorted((k, n) for k, n in want.items() if k.startswith(prefix))
    read = {r.key: r.content for r in blobs.scan_uploads(spark, at, most=400).collect()}
    assert read.keys() == want.keys() and bytes(read["a/1/1"]) == b"new" and bytes(read["a/2/2"]) == b"newer" and read["b"] == b""
    assert {k for k, c in read.items() if c is None} == {k for k, n in want.items() if n > 400}


def test_messages_are_dealt_by_their_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stores, "PART_ROWS", 100)
    monkeypatch.setattr(stores.sinks, "send", lambda stream, *at: seen.append(len(stream.sparkSession.read.parquet(at[0].removesuffix("out") + "in").inputFiles())) or send(stream, *at))
    assert stores.s_outbox(spark, DATA).count() == stores.upkeep.n_outbox(spark, DATA).count()
    assert seen == [15, 15]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_accepted_rows_come_by_windows(spark):
    """An upload's order and refusal are window values; no table of one row an upload is joined or sent to the driver."""
    for query in (intake.v_accepted, reading.m_top, reading.m_weight):
        plan = _plan(query(spark, DATA))
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1 and "read-cells" not in plan


def test_products_to_review_meet_their_categories_by_shuffle(spark):
    for query in (reading.m_review, reading.m_category):
        assert "Broadcast" not in _plan(query(spark, DATA))


def test_problems_meet_their_uploads_by_shuffle(spark):
    """Of what findings are joined with, only the dictionary of fixed size is broadcast."""
    assert _plan(intake.v_width(spark, DATA)).count("BroadcastExchange") <= 1
    assert _plan(intake.f_rejection(spark, DATA)).count("BroadcastExchange") <= 1


def test_rules_run_as_compiled_code(spark):
    """The generators only hand on a struct that a projection below made, outside the stage's generated method."""
    rows = spark.range(8).selectExpr("id AS upload", "CAST(id AS INT) AS line", "concat('beef', id) AS product", "concat(id, '/2/2005') AS date", "string(id) AS weight")
    lines = _plan(rules.read_cells(rows, "2011-12-31 12:00:00")).splitlines()
    made = [i for i, x in enumerate(lines) if "Generate inline" in x]
    assert all("_made" in lines[i] and "RLIKE" not in lines[i] and "Project" in lines[i + 1] and "*(" not in lines[i + 1] for i in made)


def test_numbers_are_read_by_their_place(spark):
    dates = {
        "2005/1/5": "2005-01-05", "2005.12.5": "2005-12-05", "2005-1-15T1:30": "2005-01-15", "2005-11-5 10:30": "2005-11-05", "20050115": "2005-01-15",
        "2005-1": "2005-01-01", "1.2005": "2005-01-01", "5 jan 05": "2005-01-05", "Jan-15,-2005": "2005-01-15", "1/2/05": "numeric 1 2 2005",
        "11-2-2005": "numeric 11 2 2005", "3.12.0050": "numeric 3 12 50", "31/12/11": "numeric 31 12 2011", "5 jan 205": "too-old", "2005-02-29": "not-a-real-date",
    }
    rows = spark.createDataFrame([(i, 2, "beef", d, "3") for i, d in enumerate(dates)], "upload long, line int, product string, date string, weight string")
    got = {r.date: r.iso or r.date_fault or f"numeric {r.first} {r.second} {r.year}" for r in rules.read_cells(rows, "2011-12-31 12:00:00").collect()}
    assert got == dates


def test_unnamed_uploads_refuse_nobody(spark):
    rows = spark.createDataFrame([(None, 2, "", "1/2/2005", "3"), (1, 2, "beef", "13/2/2005", "3"), (1, 3, "beef", "1/2/2005", "4"), (2, 2, "beef", "1/2/2005", "3")], "upload long, line int, product string, date string, weight string")
    judged = rules.judge(rules.read_cells(rows, "2011-12-31 12:00:00"), "2011-12-31 12:00:00")
    assert sorted((r.upload, r.line, r.iso) for r in findings.accept(judged).collect()) == [(1, 2, "2005-02-13"), (1, 3, "2005-02-01")]


def test_accepted_rows_are_shuffled_once_by_upload(spark):
    """Lines meet their parts and then their upload; the window that decides on an upload needs no shuffle, sort or generator more."""
    for query in (intake.v_accepted, intake.v_coverage, intake.v_months):
        plan = _plan(query(spark, DATA))
        assert plan.count("Exchange hashpartitioning") == 3 and plan.count(" Sort [") == 3 and "Generate" not in plan
        # Each step of the rules is a projection outside the stage's generated method.
        steps = [x for x in plan.splitlines() if "Project" in x and "lambdafunction(lambda x" in x]
        assert len(steps) == 4 and not [x for x in steps if "*(" in x]


def test_projected_rules_give_what_generated_ones_give(spark):
    odd = ["", " ", "N/A", "=a", "a​", "x" * 201, "beef", "5 oz", "1e3", "(5)", "1,000.5", "12", "45000", "2005-02-30", "13/2/2005", "2/13/2005", "1/2/2005", "5 jan 05", "Foo 2005", "20050115", None]
    rows = [(i % 7 or None, i, odd[i % 21], odd[i * 5 % 21], odd[i * 2 % 17], 3 + (i % 29 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "upload long, line int, product string, date string, weight string, actual int").selectExpr("*", "3 AS expected")
    now = "2011-12-31 12:00:00"
    one, other = (rules.read_cells(table, now, filtered) for filtered in (True, False))
    assert one.dtypes == other.select(*one.columns).dtypes
    for made in (lambda read: read, lambda read: rules.judge(read, now)):
        assert sorted(map(repr, made(one).collect())) == sorted(map(repr, made(other.select(*one.columns)).collect()))


def test_months_are_compared_once_and_words_made_of_what_is_left(spark):
    met = [x for x in _plan(intake.v_coverage(spark, DATA)).splitlines() if "Filter" in x and "array_except" in x]
    assert len(met) == 1 and met[0].count("array_except") == 1 and "Your file" not in met[0]


def test_uncovered_uploads_are_those_with_a_summary(spark):
    rows = [(1, ["2005-01"], {}), (2, ["2005-01", "2005-02"], {"2005-01": 1}), (3, ["2005-01"], {"2005-01": None}), (4, [], {}), (5, None, {}), (6, ["2005-01"], None), (None, ["2005-03", "2005-01", "2005-02"], {"x": 1})]
    counted = spark.createDataFrame(rows, "upload long, months array<string>, counts map<string,int>")
    wanted = submission.coverage(counted).where("summary IS NOT NULL")
    got = submission.uncovered(counted)
    assert got.columns == wanted.columns and sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    assert {r.upload for r in got.collect()} == {1, 2, None}
