"""The layout of files over 64K characters: the first ten records decide, however long they or the file are."""

from test_uploads import _read

HEAD, ROW = "product,date,weight\n", "beef,2026-01-05,12.5\n"


def test_faults_of_long_files(spark):
    many, long = ROW * 3500, "x" * 70_000
    read, refused = _read(
        spark,
        {
            "wide": (HEAD + "a" + ";x" * 30 + ",2026-01-05,1\n" + many).encode(),
            "open": ("title\n" + '"' + many).encode(),
            "after": ('title\n"a"b\n' + many).encode(),
            "twice": (HEAD + long + ",2026-01-05,1\n" + HEAD).encode(),
            "none": ("title\n" + many).encode(),
            "deep": (long + "\n" + HEAD + ROW).encode(),
            "blank": ("\n" * 70_000 + HEAD + ROW).encode(),
            "later": (HEAD + ROW * 9 + many + "a" + ";x" * 30 + ",2026-01-05,1\n").encode(),
        },
    )
    assert refused == {
        "wide": ("too_large", "too-many-columns at line 2"),
        "open": ("unparseable", "unclosed-quote at line 2"),
        "after": ("unparseable", "text-after-quote at line 2"),
        "twice": ("bad_columns", '"," at line 1 and "," at line 3'),
        "none": ("bad_columns", "missing column(s): product, date, weight"),
    }
    assert read["deep"] == [(3, "beef", "2026-01-05", "12.5")] and read["blank"] == [(70_002, "beef", "2026-01-05", "12.5")]
    assert len(read["later"]) == 3510


def test_lines_of_records_with_line_ends_inside(spark):
    records, expected, line = [], [], 2
    for i in range(1000):
        name = "\n".join(["part"] * (1 + i % 3)) if i % 5 else "plain"
        records.append((f'"{name}"' if "\n" in name else name) + ",2026-01-05,1\n" + "\n" * (i % 7 == 0))
        expected.append((line, name, "2026-01-05", "1"))
        line += records[-1].count("\n")
    good = HEAD + "".join(records)
    read, refused = _read(spark, {"good": good.encode(), "late": (good + 'x,"y"z\n').encode()})
    assert read["good"] == expected
    assert refused == {"late": ("unparseable", f"text-after-quote at line {line}")}
