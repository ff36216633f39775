"""Queries over whole files: decode, tokenize, layout, verdict. The twins select the rows the files were built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import findings, rules, submission, uploads
from larder.plans.intake import CTES
from larder.sources.views import NOW, view, with_views


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The derived uploads, with some files damaged in known ways."""
    built = uploads.write_out(view(spark, d, "cells"))
    kind = F.pmod("upload", F.lit(101))
    damaged = (
        F.when(kind == 3, F.concat(F.unhex(F.lit("504B0304")), F.col("content")))
        .when(kind == 5, F.encode(F.lit("product,date\nbeef,2005-01-01\n"), "UTF-8"))
        .when(kind == 7, F.encode(F.lit('product,date,weight\nbeef,2005-01-01,"12\n'), "UTF-8"))
        .when(kind == 11, F.encode(F.lit('product,date,weight\n"be"ef,2005-01-01,12\n'), "UTF-8"))
        .when(kind == 13, F.encode(F.lit("product,date,weight\n"), "UTF-8"))
        .when(kind == 17, F.encode(F.lit(" \n\t\n"), "UTF-8"))
        .when(kind == 19, F.encode(F.lit("product,date,weight\nbeef" + ",x" * 30 + "\n"), "UTF-8"))
        .when(kind == 23, F.encode(F.lit("product,item,date,weight\na,b,2005-01-01,3\n"), "UTF-8"))
        .when(kind == 29, F.encode(F.lit("product,date,weight\nbe\x02ef,2005-01-01,3\n"), "UTF-8"))
        .when(kind == 31, F.unhex(F.lit("")))
        .when(kind == 37, F.encode(F.lit("product,date,weight\nproduct,date,weight\n"), "UTF-8"))
        .otherwise(F.col("content"))
    )
    return built.withColumn("content", damaged).withColumn("size", F.length("content"))


def d_decode(spark: SparkSession, d: str) -> DataFrame:
    """Gates of every file."""
    return uploads.decode(_files(spark, d)).select("upload", "gate", "control_code", "control_offset")


def d_tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Every record of undamaged files, back as the rows they were written from."""
    read = uploads.read_files(uploads.decode(uploads.write_out(view(spark, d, "cells"))))
    return uploads.rows_of(read).select("upload", "line", "product", "date", "weight")


CAP = 4


def d_row_cap(spark: SparkSession, d: str) -> DataFrame:
    """With a cap of a few rows, the files that have more; nothing of them is read."""
    read = uploads.read_files(uploads.decode(uploads.write_out(view(spark, d, "cells"))), cap=CAP).withColumn("laid", F.col("delimiter").isNotNull())
    counted = uploads.rows_of(read, "file_fault", "laid", outer=True).groupBy("upload").agg(F.max("file_fault").alias("file_fault"), F.count("line").alias("n"), F.max("laid").alias("laid"))
    return counted.where("laid").drop("laid")


def d_layout(spark: SparkSession, d: str) -> DataFrame:
    decoded = uploads.decode(_files(spark, d))
    return uploads.find_layout(decoded).select("upload", "delimiter", "header_line", "width", "layout_fault", "parse_fault", "parse_line")


def t_modified(spark: SparkSession, d: str) -> DataFrame:
    """Documents sent as files, some with a byte order mark or other line ends, against what is kept of them."""
    text = F.when(F.col("doc_id") % 5 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    content = F.concat(F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.encode(text, "UTF-8"))
    sent = view(spark, d, "documents").select("doc_id", content.alias("content"))
    kept = uploads.decode(sent.withColumn("size", F.length("content"))).where(F.col("gate").isNull())
    return kept.select("doc_id", *submission.describe_input(F.col("content"), F.encode("text", "UTF-8")))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return uploads.read_files(uploads.decode(_files(spark, d)))


def f_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return uploads.describe_unreadable(_read(spark, d))


def v_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One outcome per file: the first reason to refuse it, or accepted.

    Files, their rows and what is found in them stay where the upload's lines were
    shuffled to; only a file's outcome meets its form.
    """
    files = _read(spark, d).withColumn("reason", uploads.unreadable_reason())
    cells = rules.read_cells(uploads.rows_of(files, "gate", "reason", outer=True), NOW, filtered=False)
    return submission.verdict(findings.outcomes(rules.judge(cells, NOW), "gate", "reason"), view(spark, d, "forms"))


QUERIES = {"d_decode": d_decode, "d_tokenize": d_tokenize, "d_row_cap": d_row_cap, "d_layout": d_layout, "t_modified": t_modified, "f_unreadable": f_unreadable, "v_verdict": v_verdict}

_KIND = "upload % 101"
_UPLOADS = "(SELECT DISTINCT upload FROM cells) u"
_EXPECTED = {
    3: ("unparseable", "That looks like an Excel (.xlsx) file, not a CSV. Save it as CSV and upload it again.", "signature matched xlsx"),
    5: ("bad_columns", "Your file needs a column for weight.", "missing column(s): weight"),
    7: ("unparseable", "The quotes starting on line 2 are never closed, so we cannot tell where that row ends.", "unclosed-quote at line 2"),
    11: ("unparseable", "Line 2 has text after a closing quote. A quoted value has to fill the whole cell.", "text-after-quote at line 2"),
    13: ("empty", "That file has a header but no rows under it.", None),
    17: ("empty", "That file has no rows in it.", None),
    19: ("too_large", "That file has more than 25 columns, far past what we can read.", "too-many-columns at line 2"),
    23: ("bad_columns", 'Two columns could be the product name: "product" and "item". Remove or rename one.', "ambiguous column: product (product | item)"),
    29: ("unparseable", "That file does not look like text. Save it as CSV (comma separated values) and upload it again.", "control character 0x2 at offset 22"),
    31: ("empty", "That file has no rows in it.", None),
    37: ("bad_columns", "We can't tell what separates your columns — this file could be split into columns more than one way. Save it as CSV (comma separated values) and upload it again.", '"," at line 1 and "," at line 2'),
}


def _case(i: int) -> str:
    def lit(v: str | None) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    return f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN {lit(v[i])}" for k, v in _EXPECTED.items()) + " END"


_BROKEN = ", ".join(map(str, _EXPECTED))
ORACLE_SQL = {
    "d_decode": with_views(f"SELECT upload, CASE {_KIND} WHEN 3 THEN 'signature-xlsx' WHEN 17 THEN 'blank' WHEN 29 THEN 'control-character' WHEN 31 THEN 'empty' END AS gate, CASE {_KIND} WHEN 29 THEN 2 END AS control_code, CASE {_KIND} WHEN 29 THEN 22 END AS control_offset FROM {_UPLOADS}"),
    "t_modified": """SELECT doc_id, strlen(kept) AS byte_size, sha256(kept) AS checksum, sent <> kept AS is_modified FROM (
  SELECT doc_id, sent, regexp_replace(ltrim(sent, chr(65279)), '\\r\\n?', chr(10), 'g') AS kept FROM (
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN chr(65279) || text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS sent FROM documents))
WHERE regexp_matches(kept, '\\S') AND NOT regexp_matches(kept, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AND NOT starts_with(sent, 'PK')""",
    "d_row_cap": with_views(f"SELECT upload, CASE WHEN count(*) > {CAP} THEN 'too-many-rows' END AS file_fault, CASE WHEN count(*) > {CAP} THEN 0 ELSE count(*) END AS n FROM cells GROUP BY 1"),
    "d_tokenize": with_views("SELECT upload, line, product, date, weight FROM cells"),
    "d_layout": with_views(f"""SELECT upload, CASE WHEN {_KIND} IN (13) THEN ',' WHEN {_KIND} IN ({_BROKEN}) THEN NULL ELSE [',', ';', chr(9), '|'][upload % 4 + 1] END AS delimiter,
  CASE WHEN {_KIND} IN (5, 7, 11, 19, 23, 37) THEN NULL ELSE 1 END AS header_line, CASE WHEN {_KIND} IN (5, 7, 11, 19, 23, 37) THEN NULL ELSE 3 END AS width,
  CASE WHEN {_KIND} IN (7, 11, 19) THEN 'parse-error' WHEN {_KIND} IN (5, 23) THEN 'bad-header' WHEN {_KIND} = 37 THEN 'ambiguous' END AS layout_fault,
  CASE {_KIND} WHEN 7 THEN 'unclosed-quote' WHEN 11 THEN 'text-after-quote' WHEN 19 THEN 'too-many-columns' END AS parse_fault, CASE WHEN {_KIND} IN (7, 11, 19) THEN 2 END AS parse_line
FROM {_UPLOADS} WHERE {_KIND} NOT IN (3, 17, 29, 31)"""),
    "f_unreadable": with_views(f"SELECT upload, {_case(0)} AS reason, {_case(1)} AS summary, {_case(2)} AS detail FROM {_UPLOADS} WHERE {_KIND} IN ({_BROKEN})"),
    "v_verdict": with_views(
        f"""SELECT upload, coalesce(first, CASE WHEN len(missing) > 0 THEN 'invalid_metadata' ELSE 'accepted' END) AS verdict,
  CASE WHEN first IS NULL AND len(missing) > 0 THEN 'months in the file with no count: ' || array_to_string(missing, ', ') END AS uncounted
FROM (SELECT upload, [x FOR x IN months IF NOT contains(counts, '"' || x || '"')] AS missing, coalesce(CASE WHEN {_KIND} = 31 THEN 'empty' WHEN upload % 43 = 1 OR upload % 47 = 3 OR upload % 53 = 4 THEN 'invalid_metadata' END, {_case(0)},
  CASE WHEN upload IN (SELECT upload FROM found) OR order_fault IS NOT NULL THEN 'bad_rows' END) AS first
  FROM decided JOIN forms USING (upload) LEFT JOIN months USING (upload)) x""",
        CTES,
    ),
}
