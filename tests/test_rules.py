"""Golden vectors of the cell rules."""

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import findings, rules

NOW = "2026-12-01 00:00:00"
DATES = {
    "2025-03-04": ("2025-03-04", None), "2025.3.4": ("2025-03-04", None), "20250304": ("2025-03-04", None), "4 Mar 2025": ("2025-03-04", None), "Mar 4, 2025": ("2025-03-04", None),
    "4-March-2025": ("2025-03-04", None), "4 sept 2025": ("2025-09-04", None), "2024-02-29": ("2024-02-29", None), "2025-03-04T10:20:30.5+02:00": ("2025-03-04", None), "Jun 2024": ("2024-06-01", None),
    "2024-06": ("2024-06-01", None), "06/2024": ("2024-06-01", None), "45000": (None, "date-serial"), "45292.542": (None, "date-serial"), "01/02": (None, "unrecognized"), "4th March 2025": (None, "unrecognized"),
    "Foo 2025": (None, "unknown-month-name"), "2025-02-30": (None, "not-a-real-date"), "2025-13-01": (None, "not-a-real-date"), "13/13/2025": (None, "not-a-real-date"), "0050-01-01": (None, "not-a-real-date"),
    "4 mar 202": (None, "too-old"), "2031-01-01": (None, "too-far-ahead"), "Mar 4,2025": (None, "unrecognized"), "": (None, "empty"), " 12.2024 ": ("2024-12-01", None), "2025-03/04": ("2025-03-04", None),
}
WEIGHTS = {
    "123": (123.0, None), "1,234.50": (1234.5, None), "  12  ": (12.0, None), "007": (7.0, None), "0": (0.0, None), "5 oz": (None, "has-a-unit"), "inf": (None, "not-a-number"), "$12": (None, "money"),
    "12 €": (None, "money"), "1e3": (None, "scientific"), "(50)": (None, "parenthesized-negative"), "-5": (None, "negative"), "-Infinity": (None, "negative"), "1.234,56": (None, "comma-decimal"),
    "1,23,456": (None, "comma-decimal"), "1 234": (None, "not-plain"), ".5": (None, "not-plain"), "5.": (None, "not-plain"), "１２": (None, "not-plain"), "1234567890123456": (None, "too-many-digits"), "12\n": (12.0, None),
}
PRODUCTS = {" beef ": ("beef", None), "": (None, "empty"), "N/A": (None, "placeholder"), "be​ef": (None, "invisible-character"), "=1+1": (None, "formula"), "beef\tmince": (None, "invisible-character")}


def test_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "raw string")
    read = rules.read_cells(rows.select(F.lit(1).alias("upload"), F.lit(1).alias("line"), F.lit("p").alias("product"), F.col("raw").alias("date"), F.lit("1").alias("weight")), NOW)
    assert {r["date"]: (r["iso"], r["date_fault"]) for r in read.collect()} == DATES


@pytest.mark.parametrize(("rule", "vectors"), [(rules.read_weight, WEIGHTS), (rules.read_product, PRODUCTS)])
def test_values(spark, rule, vectors):
    rows = spark.createDataFrame([(k,) for k in vectors], "raw string").select("raw", rule(F.col("raw")).alias("r"))
    got = {r["raw"]: (None if r["r"]["fault"] else r["r"]["value"], r["r"]["fault"]) for r in rows.collect()}
    assert got == vectors


def _normalize(spark, lines):
    rows = spark.createDataFrame([(1, i + 2, *x) for i, x in enumerate(lines)], "upload long, line int, product string, date string, weight string")
    return findings.normalize(rules.read_cells(rows, NOW), NOW)


def test_order_is_decided_for_the_whole_column(spark):
    done = _normalize(spark, [("a", "13/03/2026", "3"), ("b", "01/04/2026", "0")])
    assert [r["iso"] for r in done["accepted"].orderBy("line").collect()] == ["2026-03-13", "2026-04-01"]


def test_contradictory_order_rejects_without_failing_rows(spark):
    got = _normalize(spark, [("a", "13/03/2026", "3"), ("b", "03/13/2026", "1")])["rejected"].first()
    assert got["summary"] == "We found problems in 0 of your 2 rows." and "row 2 has" in got["date_order_problem"]


def test_a_row_with_a_fault_does_not_vote(spark):
    got = _normalize(spark, [("a", "13/03/2026", "5 oz"), ("b", "01/04/2026", "1")])["rejected"].first()
    assert len(got["problems"]) == 1 and "2026-04-01 or 2026-01-04" in got["date_order_problem"]


def test_ranges_examples_and_caps(spark):
    lines = [("a", "2026-01-01", "5 oz" if i % 2 == 0 else "1") for i in range(20)] + [("a", "2026-01-01", "3 kg"), ("a", "2026-01-01", "4 lb")]
    row = _normalize(spark, lines)["worded"].first()
    assert row["n"] == 12 and row["rows_text"] == "12 rows: 2, 4, 6, 8, 10 and 7 more" and row["examples"] == ["5 oz", "3 kg", "4 lb"]


def test_numbers_as_text(spark):
    values = {12.5: "12.5", 3.0: "3", 1e-7: "1e-7", 1e21: "1e+21", 123456789.0: "123456789", 0.0001: "0.0001"}
    rows = spark.createDataFrame([(k,) for k in values], "x double").select("x", text.number_text(F.col("x")).alias("t"))
    assert {r["x"]: r["t"] for r in rows.collect()} == values
