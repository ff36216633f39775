"""Files are read in their own rows: no text meets its layout by a join or a broadcast."""

import random

from conftest import DATA
from pyspark.sql import functions as F

from larder.operators import findings, rules, submission, uploads
from larder.plans import files


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_cap_sends_no_layouts_to_the_driver(spark):
    plan = _plan(files.d_row_cap(spark, DATA))
    assert "Broadcast" not in plan and plan.count("Join") == 1  # that of lines and parts


def test_layouts_are_never_broadcast(spark):
    decoded = spark.createDataFrame([(1, None, "product,date,weight\na,b,c\n")], "upload long, gate string, text string")
    rows, later = uploads.data_rows(decoded, uploads.find_layout(decoded))
    assert "Broadcast" not in _plan(rows) + _plan(later)


def _odd_files():
    """Files of random pieces, plain ones and all kinds of others."""
    rng = random.Random(3)
    heads = ["product,date,weight", "Item_Name;order date; WEIGHT ", "item\tdate\tweight", "product|date|weight|note", "product;date,weight", "a,b;product,date,weight", "product,item,date,weight", "weight,date", "", "title", '"product";date;weight', "product,date,weight;x;y"]
    rows = ["a,b,c", "a;b;c", "a\tb\tc", "a|b|c|d", '"a,b";c;d', 'x,"y\nz",1', "", "product,date,weight", "Jan 5, 2005;b;c", ",".join("x" * 26), ";".join("y" * 25), 'a,"b"c,d', ",,", "é;ü;ß", '"open']
    out = ["\n", "product,date,weight", "product,date,weight\n\n", "\nproduct,date,weight\na,b,c\n", ",".join(["product", "date", "weight", *"x" * 22]) + "\n" + ",".join("z" * 25)]
    for i in range(600):
        lines = [rng.choice(heads) for _ in range(1 + (i % 7 == 0))] + [rng.choice(rows[: 5 if i % 3 else None]) for _ in range(rng.randint(0, 14))]
        out.append("\n".join(lines) + "\n" * (i % 2))
    return out


def test_plain_files_are_read_as_all_others(spark, monkeypatch):
    """The lane of texts without quotes gives what the patterns give."""
    decoded = spark.createDataFrame([(i, None, t, bytearray(b"")) for i, t in enumerate(_odd_files())], "upload long, gate string, text string, content binary")

    def everything():
        read = uploads.read_files(decoded, cap=9)
        recs = read.select("upload", *uploads.LAYOUT, "file_fault", F.transform("data", lambda x: F.struct(x["line"], F.rtrim(x["rec"], F.lit("\n")))).alias("data"))
        return {r.upload: repr(r) for r in recs.collect()}, sorted(map(repr, uploads.rows_of(read).collect())), read

    plain, rows, read = everything()
    assert read.where(F.col("delimiter").isNotNull()).count() > 100 and len(rows) > 200
    monkeypatch.setattr(uploads, "QUOTE", "")  # every text contains it, so none is plain
    every, same_rows, _ = everything()
    assert plain == every and rows == same_rows


def test_files_are_read_as_by_a_join(spark):
    texts = _odd_files()
    decoded = spark.createDataFrame([(i, ["control-character", None][i % 9 > 0], t, bytearray(b"")) for i, t in enumerate(texts)], "upload long, gate string, text string, content binary")
    layout = uploads.find_layout(decoded)
    rows, later = uploads.data_rows(decoded, layout, cap=9)
    read = uploads.read_files(decoded, cap=9)
    assert read.count() == len(texts)
    assert sorted(map(repr, uploads.rows_of(read).collect())) == sorted(map(repr, rows.collect()))
    met = decoded.select("upload").join(layout.withColumnsRenamed({"parse_fault": "lf", "parse_line": "ll"}), "upload", "left").join(later, "upload", "left")
    met = met.withColumns({"parse_fault": F.coalesce("lf", "parse_fault"), "parse_line": F.coalesce("ll", "parse_line")})
    columns = ["upload", *uploads.LAYOUT, "file_fault"]
    assert sorted(map(repr, read.select(*columns).collect())) == sorted(map(repr, met.select(*columns).collect()))


def test_verdicts_meet_only_their_forms(spark):
    """Rows stay where the upload's lines were shuffled to: the joins are those of lines with parts and of outcomes with forms."""
    plan = _plan(files.v_verdict(spark, DATA))
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 4


def test_an_undecidable_order_of_unreal_dates_refuses(spark):
    """Dates that are real under no order are still at fault: their upload is refused, and not accepted without rows."""
    rows = spark.createDataFrame([(1, None, None, 2, "beef", "3.12.0050", "3")], "upload long, gate string, reason string, line int, product string, date string, weight string")
    judged = rules.judge(rules.read_cells(rows, "2011-12-31 12:00:00", filtered=False), "2011-12-31 12:00:00")
    forms = spark.createDataFrame([(1, "a", None, "people", "kg", '{"2005-01": 3}')], "upload long, name string, site_name string, counts_basis string, unit_system string, counts string")
    assert submission.verdict(findings.outcomes(judged, "gate", "reason"), forms).first().verdict == "bad_rows"


def test_simple_counts_are_as_parsed_ones(spark, monkeypatch):
    counts = ['{"2005-01": 3, "2005-02": 0}', '{"2005-01":3}', '{"2005-13": 3}', '{"2005-01": 03}', '{"2005-01": 3, "2005-01": 4}', "{}", '{"2005-01": true}', None, '{"2005-01": 3.0}', " ", '{"2005-01": 3}\n']
    counts.append("{" + ", ".join(f'"{y}-{m:02}": 1' for y in range(2000, 2011) for m in range(1, 13)) + "}")
    forms = spark.createDataFrame([(i, "a", None, "people", "kg", c) for i, c in enumerate(counts)], "upload long, name string, site_name string, counts_basis string, unit_system string, counts string")

    def checked():
        return {r.upload: (r.bad_fields, r.counted) for r in submission.check_metadata(forms).collect() if r.upload not in (4,)}

    quick, bad = checked(), {r.upload for r in submission.check_metadata(forms).collect() if r.bad_fields}
    monkeypatch.setattr(submission, "SIMPLE_COUNTS", r"^\b$")
    assert quick == checked() and {0, 1, 8}.isdisjoint(bad) and {2, 5, 6, 7, 9, 11} <= bad
