"""Decoding, tokenizing and layout of single files."""

from larder.operators import uploads


def _read(spark, files, cap=500_000):
    df = spark.createDataFrame([(k, bytearray(v), len(v)) for k, v in files.items()], "upload string, content binary, size long")
    decoded = uploads.decode(df)
    layout = uploads.find_layout(decoded)
    rows, later = uploads.data_rows(decoded, layout, cap)
    met = decoded.drop("text", "content").join(layout.withColumnsRenamed({"parse_fault": "lf", "parse_line": "ll"}), "upload", "left").join(later, "upload", "left")
    from pyspark.sql import functions as F

    met = met.withColumns({"parse_fault": F.coalesce("lf", "parse_fault"), "parse_line": F.coalesce("ll", "parse_line")})
    refused = {r["upload"]: (r["reason"], r["detail"]) for r in uploads.describe_unreadable(met, cap).collect()}
    read = {}
    for r in rows.orderBy("upload", "line").collect():
        read.setdefault(r["upload"], []).append((r["line"], r["product"], r["date"], r["weight"]))
    return read, refused


def test_everything_odd_at_once(spark):
    text = 'Orders\n\nproduct name;date ordered;weight;supplier\n"beef, minced";2026-01-05;12.5;Acme\n"two\nlines";2026-01-06;1;B\n\n"say ""hi""";2026-01-07;2;\n'
    read, refused = _read(spark, {"a": text.encode(), "b": text.encode("utf-16-le").join([b"\xff\xfe", b""]), "c": text.replace("beef", "bœuf€").encode("cp1252")})
    assert not refused
    assert read["a"] == [(4, "beef, minced", "2026-01-05", "12.5"), (5, "two\nlines", "2026-01-06", "1"), (8, 'say "hi"', "2026-01-07", "2")]
    assert read["b"] == read["a"] and read["c"][0][1] == "bœuf€, minced"


def test_gates(spark):
    head = b"product,date,weight\n"
    _, refused = _read(
        spark,
        {
            "xlsx": b"PK\x03\x04rest", "zero": b"", "columns": b"product,date\na,b\n", "open": head + b'"a,2026-01-01,1\n', "after": head + b'"a"b,2026-01-01,1\n', "none": head,
            "wide": head + b"a" + b",x" * 25 + b"\n", "many": head + b"a,2026-01-01,1\n" * 4,
        },
        cap=3,
    )
    assert {k: v[0] for k, v in refused.items()} == {
        "xlsx": "unparseable", "zero": "empty", "columns": "bad_columns", "open": "unparseable", "after": "unparseable", "none": "empty", "wide": "too_large", "many": "too_large",
    }
    assert refused["open"][1] == "unclosed-quote at line 2" and refused["wide"][1] == "too-many-columns at line 2"
