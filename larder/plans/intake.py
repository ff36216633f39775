"""Queries over the derived cells: rules, findings, wording, rejections, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import fixed, text
from larder.operators import findings, rules, submission
from larder.sources.views import NOW, view, with_views

EARLIEST, LATEST = rules.bounds_at(NOW)


def _read(spark: SparkSession, d: str, filtered: bool = False) -> DataFrame:
    return rules.read_cells(view(spark, d, "cells"), NOW, filtered)


def _all(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return findings.normalize(_read(spark, d), NOW)


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return findings.accept(rules.judge(_read(spark, d), NOW))


def v_product(spark: SparkSession, d: str) -> DataFrame:
    read = rules.once(view(spark, d, "cells"), p=rules.read_product(F.col("product")))
    fault = F.when(F.length("product") > fixed.MAX_FREE_TEXT_LENGTH, "too-long").otherwise(F.col("p.fault"))
    return read.select("upload", "line", F.when(fault.isNull(), F.col("p.value")).alias("product_value"), fault.alias("product_fault"))


def v_weight(spark: SparkSession, d: str) -> DataFrame:
    read = rules.once(view(spark, d, "cells"), w=rules.read_weight(F.col("weight")))
    return read.select("upload", "line", F.col("w.value").alias("weight_value"), F.col("w.fault").alias("weight_fault"))


def v_date(spark: SparkSession, d: str) -> DataFrame:
    read = _read(spark, d)
    return read.select(
        "upload", "line", "date_kind", "date_fault", "iso", "first", "second", "year",
        F.when(F.col("date_kind") == "numeric", rules.order_proven(F.col("first"), F.col("second"))).alias("proven"),
    )


def v_too_long(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, filtered=True).where(F.size("too_long") > 0).select("upload", "line", F.array_join("too_long", ",").alias("columns"))


def v_order(spark: SparkSession, d: str) -> DataFrame:
    decided = rules.decide_order(_read(spark, d))
    return decided.select(
        "upload", "rows_read", "date_order", "order_fault",
        *[F.col(f"{c}.line").alias(f"{c}_line") for c in ("day_first", "month_first", "ambiguous")],
    )


def v_resolve(spark: SparkSession, d: str) -> DataFrame:
    return rules.resolved_rows(rules.judge(_read(spark, d), NOW)).select("upload", "line", "resolved_iso", "resolved_fault")


def v_both_readings(spark: SparkSession, d: str) -> DataFrame:
    read = _read(spark, d, filtered=True).where((F.col("date_kind") == "numeric") & (F.col("first") <= 12) & (F.col("second") <= 12))
    return read.select("upload", "line", rules.both_readings(F.col("first"), F.col("second"), F.col("year")).alias("b")).select("upload", "line", "b.*")


def v_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d)


def v_months(spark: SparkSession, d: str) -> DataFrame:
    return findings.months_of(_accepted(spark, d)).select("upload", F.array_join("months", ",").alias("months"))


def v_output_line(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d).select("upload", "line", submission.output_line(F.col("product"), F.col("iso"), F.col("weight")).alias("text"))


def _widths(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "cells")
    odd = (F.col("upload") + F.col("line")) % 29 == 4
    return cells.withColumns({"expected": F.lit(3), "actual": F.when(odd, F.when(F.col("line") % 2 == 0, 2).otherwise(5)).otherwise(3)})


def v_width(spark: SparkSession, d: str) -> DataFrame:
    """V1: rows with other widths than the header's, folded and worded; they have no other problem."""
    parts = findings.normalize(rules.read_cells(_widths(spark, d), NOW), NOW)
    n = parts["groups"].select("upload", "key", "n")
    return parts["worded"].where(F.col("key").startswith("width")).select("upload", "key", "rule").join(n.hint("merge"), ["upload", "key"])


def v_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every month but July has a count."""
    months = findings.months_of(_accepted(spark, d))
    known = F.filter("months", lambda m: F.substring(m, 6, 2) != "07")
    counted = months.withColumn("counts", F.map_from_arrays(known, F.array_repeat(F.lit(1), F.size(known))))
    return submission.uncovered(counted).select("upload", "summary", "detail")


def f_findings(spark: SparkSession, d: str) -> DataFrame:
    groups = _all(spark, d)["groups"]
    return groups.select(
        "upload", "key", "n",
        F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("ranges"),
        F.array_join("examples", "¦").alias("examples"),
        F.col("first_at.line").alias("first_line"),
        F.col("finding.raw").alias("raw"),
    )


def f_failing_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = _all(spark, d)
    return parts["decided"].join(findings.failing_rows(parts["found"]).hint("merge"), "upload", "left").select(
        "upload", "rows_read", F.coalesce("failing", F.lit(0)).alias("failing")
    )


def f_problem_words(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)["worded"].select("upload", "key", "rule", "advice", "rows_text", F.array_join("quoted", " ").alias("quoted"))


def f_order_problem(spark: SparkSession, d: str) -> DataFrame:
    return findings.order_problem(rules.decide_order(_read(spark, d)))


def f_rejection(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)["rejected"].select("upload", "reason", "summary", F.size("problems").alias("n_problems"), "date_order_problem", "detail")


QUERIES = {
    "v_product": v_product, "v_weight": v_weight, "v_date": v_date, "v_too_long": v_too_long, "v_order": v_order,
    "v_resolve": v_resolve, "v_both_readings": v_both_readings, "v_accepted": v_accepted, "v_months": v_months,
    "v_output_line": v_output_line, "v_width": v_width, "v_coverage": v_coverage, "f_findings": f_findings, "f_failing_rows": f_failing_rows,
    "f_problem_words": f_problem_words, "f_order_problem": f_order_problem, "f_rejection": f_rejection,
}


def _in(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _date_case(group: dict[str, str]) -> str:
    """One CASE over the grammars; ``group`` has the result for each."""
    parts = [
        ("YEAR_FIRST", rules.YEAR_FIRST), ("YEAR_FIRST_TIME", rules.YEAR_FIRST_TIME), ("COMPACT", rules.COMPACT), ("YEAR_MONTH", rules.YEAR_MONTH),
        ("MONTH_YEAR", rules.MONTH_YEAR), ("DAY_NAME_YEAR", rules.DAY_NAME_YEAR), ("NAME_DAY_YEAR", rules.NAME_DAY_YEAR), ("NAME_YEAR", rules.NAME_YEAR),
        ("YEAR_LAST", rules.YEAR_LAST), ("SERIAL", rules.SERIAL),
    ]
    whens = "".join(f" WHEN regexp_matches(cd, '{p}') THEN {group[n].replace('{p}', p)}" for n, p in parts)
    return f"CASE WHEN cd = '' THEN {group['EMPTY']}{whens} ELSE {group['ELSE']} END"


def _g(i: int) -> str:
    return f"TRY_CAST(regexp_extract(cd, '{{p}}', {i}) AS INT)"


def _y(i: int) -> str:
    token = f"regexp_extract(cd, '{{p}}', {i})"
    return f"CASE WHEN length({token}) = 2 THEN 2000 + CAST({token} AS INT) ELSE TRY_CAST({token} AS INT) END"


def _m(i: int) -> str:
    return "CASE regexp_extract(cd, '{p}', %d) %s END" % (i, " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.MONTHS.items()))


_N = "NULL"
_KIND = _date_case({**dict.fromkeys(["YEAR_FIRST", "YEAR_FIRST_TIME", "COMPACT", "YEAR_MONTH", "MONTH_YEAR"], "'date'"),
    "DAY_NAME_YEAR": f"CASE WHEN {_m(2)} IS NULL THEN 'unknown-month-name' ELSE 'date' END",
    "NAME_DAY_YEAR": f"CASE WHEN {_m(1)} IS NULL THEN 'unknown-month-name' ELSE 'date' END",
    "NAME_YEAR": f"CASE WHEN {_m(1)} IS NULL THEN 'unknown-month-name' ELSE 'date' END",
    "YEAR_LAST": f"CASE WHEN {_g(1)} > 12 AND {_g(2)} > 12 THEN 'not-a-real-date' ELSE 'numeric' END",
    "SERIAL": "'date-serial'", "EMPTY": "'empty'", "ELSE": "'unrecognized'"})
_Y = _date_case({"YEAR_FIRST": _g(1), "YEAR_FIRST_TIME": _g(1), "COMPACT": _g(1), "YEAR_MONTH": _g(1), "MONTH_YEAR": _g(2), "DAY_NAME_YEAR": _y(3),
    "NAME_DAY_YEAR": _y(3), "NAME_YEAR": _y(2), "YEAR_LAST": _y(3), "SERIAL": _N, "EMPTY": _N, "ELSE": _N})
_M = _date_case({"YEAR_FIRST": _g(2), "YEAR_FIRST_TIME": _g(2), "COMPACT": _g(2), "YEAR_MONTH": _g(2), "MONTH_YEAR": _g(1), "DAY_NAME_YEAR": _m(2),
    "NAME_DAY_YEAR": _m(1), "NAME_YEAR": _m(1), "YEAR_LAST": _g(1), "SERIAL": _N, "EMPTY": _N, "ELSE": _N})
_D = _date_case({"YEAR_FIRST": _g(3), "YEAR_FIRST_TIME": _g(3), "COMPACT": _g(3), "YEAR_MONTH": "1", "MONTH_YEAR": "1", "DAY_NAME_YEAR": _g(1),
    "NAME_DAY_YEAR": _g(2), "NAME_YEAR": "1", "YEAR_LAST": _g(2), "SERIAL": _N, "EMPTY": _N, "ELSE": _N})


def _calendar(y: str, m: str, d: str, low: str = EARLIEST, high: str = LATEST) -> tuple[str, str]:
    iso = f"printf('%04d-%02d-%02d', {y}, {m}, {d})"
    fault = f"CASE WHEN {y} < 100 OR TRY_CAST({iso} AS DATE) IS NULL THEN 'not-a-real-date' WHEN {iso} < '{low}' THEN 'too-old' WHEN {iso} > '{high}' THEN 'too-far-ahead' END"
    return iso, fault


_ISO, _FAULT = _calendar("y", "m", "d")
_DAY = "CASE WHEN date_order = 'day-first' THEN second ELSE first END"
_RISO, _RFAULT = _calendar("year", "mm", "dd")
_WEIGHT_FAULT = f"""CASE WHEN tw = '' THEN 'empty' WHEN regexp_matches(tw, '^\\(.*\\)\\z') THEN 'parenthesized-negative' WHEN starts_with(tw, '-') THEN 'negative'
    WHEN regexp_matches(tw, '[{fixed.CURRENCY_SYMBOLS}]') THEN 'money' WHEN regexp_matches(tw, '{rules.SCIENTIFIC}') THEN 'scientific'
    WHEN regexp_matches(tw, '[A-Za-z]') THEN CASE WHEN regexp_matches(tw, '[0-9]') THEN 'has-a-unit' ELSE 'not-a-number' END
    WHEN NOT regexp_matches(tw, '{rules.PLAIN_NUMBER}') THEN CASE WHEN contains(tw, ',') THEN 'comma-decimal' ELSE 'not-plain' END
    WHEN length(regexp_replace(tw, '[,.]', '', 'g')) > 15 THEN 'too-many-digits' END"""
CTES = {
    "read0": "SELECT *, trim(product) AS tp, trim(weight) AS tw, lower(replace(regexp_replace(trim(date), '\\s+', ' ', 'g'), ',', '')) AS cd, length(product) > 200 AS long FROM cells",
    "read1": f"SELECT *, {_KIND} AS kind, {_Y} AS y, {_M} AS m, {_D} AS d FROM read0",
    "readc": f"""SELECT upload, line, product, date, weight, long, CASE WHEN NOT long AND pf IS NULL THEN tp END AS product_value, CASE WHEN NOT long THEN pf END AS product_fault,
  CASE WHEN NOT long AND wf IS NULL THEN CAST(replace(tw, ',', '') AS DOUBLE) END AS weight_value, CASE WHEN NOT long THEN wf END AS weight_fault,
  CASE WHEN long THEN NULL WHEN df IS NOT NULL THEN 'invalid' ELSE kind END AS date_kind, CASE WHEN NOT long THEN df END AS date_fault,
  CASE WHEN NOT long AND kind = 'date' AND df IS NULL THEN {_ISO} END AS iso,
  CASE WHEN NOT long AND kind = 'numeric' THEN m END AS first, CASE WHEN NOT long AND kind = 'numeric' THEN d END AS second, CASE WHEN NOT long AND kind = 'numeric' THEN y END AS year,
  NOT long AND pf IS NULL AND wf IS NULL AND df IS NULL AS ok
FROM (SELECT *, CASE WHEN tp = '' THEN 'empty' WHEN lower(tp) IN ({_in(fixed.PLACEHOLDERS)}) THEN 'placeholder' WHEN regexp_matches(tp, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]') THEN 'invisible-character'
    WHEN tp[1] IN ('=', '+', '-', '@') THEN 'formula' END AS pf,
  {_WEIGHT_FAULT} AS wf,
  CASE kind WHEN 'date' THEN {_FAULT} WHEN 'numeric' THEN NULL ELSE kind END AS df FROM read1) x""",
    "weights": f"SELECT upload, line, tw, {_WEIGHT_FAULT} AS wf FROM read0",
    "votes": "SELECT *, CASE WHEN first > 12 THEN 'day-first' WHEN second > 12 THEN 'month-first' ELSE 'ambiguous' END AS class FROM readc WHERE ok AND date_kind = 'numeric'",
    "decided": """SELECT upload, rows_read, df, mf, am, CASE WHEN df IS NOT NULL AND mf IS NULL THEN 'day-first' WHEN mf IS NOT NULL AND df IS NULL THEN 'month-first' WHEN df IS NULL AND mf IS NULL AND am IS NULL THEN 'month-first' END AS date_order,
  CASE WHEN df IS NOT NULL AND mf IS NOT NULL THEN 'contradictory' WHEN df IS NULL AND mf IS NULL AND am IS NOT NULL THEN 'unresolvable' END AS order_fault
FROM (SELECT upload, count(*) AS rows_read FROM readc GROUP BY 1) u LEFT JOIN
  (SELECT upload, min(line) FILTER (class = 'day-first') AS df, min(line) FILTER (class = 'month-first') AS mf, min(line) FILTER (class = 'ambiguous') AS am FROM votes GROUP BY 1) v USING (upload)""",
    "resolved": f"""SELECT * EXCLUDE (mm, dd), CASE WHEN order_fault IS NULL THEN CASE WHEN date_kind = 'date' THEN iso WHEN rf IS NULL THEN ri END END AS resolved_iso,
  CASE WHEN order_fault IS NULL AND date_kind = 'numeric' THEN rf END AS resolved_fault
FROM (SELECT *, {_RISO} AS ri, {_RFAULT} AS rf FROM (
  SELECT r.*, date_order, order_fault, CASE WHEN date_order = 'day-first' THEN second ELSE first END AS mm, CASE WHEN date_order = 'day-first' THEN first ELSE second END AS dd
  FROM readc r JOIN decided USING (upload) WHERE ok) a) b""",
    "found": """SELECT upload, line, 0 AS phase, 0 AS ord, 'too-long|product' AS key, 'too-long' AS kind, CAST(NULL AS VARCHAR) AS fault, CAST(NULL AS VARCHAR) AS raw FROM readc WHERE long
UNION ALL SELECT upload, line, 0, 0, CASE product_fault WHEN 'formula' THEN 'formula' ELSE 'product|' || product_fault END, CASE product_fault WHEN 'formula' THEN 'formula' ELSE 'product' END, product_fault, product FROM readc WHERE product_fault IS NOT NULL
UNION ALL SELECT upload, line, 0, 1, 'weight|' || weight_fault, 'weight', weight_fault, weight FROM readc WHERE weight_fault IS NOT NULL
UNION ALL SELECT upload, line, 0, 2, 'date|' || date_fault, 'date', date_fault, date FROM readc WHERE date_fault IS NOT NULL
UNION ALL SELECT upload, line, 1, 2, 'resolved-date|' || resolved_fault, 'resolved-date', resolved_fault, date FROM resolved WHERE resolved_fault IS NOT NULL""",
    "islands": "SELECT upload, key, min(line) AS s, max(line) AS e FROM (SELECT *, line - row_number() OVER (PARTITION BY upload, key ORDER BY line) AS g FROM found) x GROUP BY upload, key, g",
    "ranged": "SELECT upload, key, list({'s': s, 'e': e} ORDER BY s) AS ranges FROM (SELECT *, row_number() OVER (PARTITION BY upload, key ORDER BY s) AS i FROM islands) x WHERE i <= 5 GROUP BY 1, 2",
    "exampled": "SELECT upload, key, list(raw ORDER BY i) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY upload, key ORDER BY seen, raw) AS i FROM (SELECT upload, key, raw, min(phase * 1000000 + line) AS seen FROM found WHERE trim(raw) <> '' GROUP BY 1, 2, 3) a) b WHERE i <= 3 GROUP BY 1, 2",
    "grouped": "SELECT f.*, ranges, coalesce(examples, []) AS examples FROM (SELECT upload, key, count(*) AS n, min(phase * 10000000 + line * 10 + ord) AS first_at, min(line) AS first_line, arg_min(raw, line) AS raw, min(kind) AS kind, min(fault) AS fault FROM found GROUP BY 1, 2) f JOIN ranged USING (upload, key) LEFT JOIN exampled USING (upload, key)",
    "words": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{kind}', '{f}', 'The {k} {c.replace(chr(39), chr(39) * 2)}', {'NULL' if a is None else chr(39) + a + chr(39)})"
        for (k, f), (c, a) in fixed.CLAUSES.items()
        for kind in ([k, "resolved-date"] if k == "date" else [k])
    )
    + ") t(kind, fault, rule, advice)",
    "worded": f"""SELECT g.upload, g.key, g.first_at, CASE g.kind WHEN 'too-long' THEN 'The product is over 200 characters long' WHEN 'formula' THEN '{fixed.FORMULA_RULE}' ELSE w.rule END AS rule, w.advice,
  CASE WHEN n = rows_read THEN 'all ' || n || ' rows' WHEN n = 1 THEN 'row ' || ranges[1].s ELSE n || ' rows: ' || list_aggregate([CASE WHEN r.e - r.s >= 2 THEN r.s || '–' || r.e WHEN r.e = r.s THEN CAST(r.s AS VARCHAR) ELSE r.s || ', ' || r.e END FOR r IN ranges], 'string_agg', ', ')
    || CASE WHEN n > list_sum([r.e - r.s + 1 FOR r IN ranges]) THEN ' and ' || (n - list_sum([r.e - r.s + 1 FOR r IN ranges])) || ' more' ELSE '' END END AS rows_text,
  ['"' || CASE WHEN length(trim(x)) > 40 THEN trim(x)[1:40] || '…' ELSE trim(x) END || '"' FOR x IN examples] AS quoted
FROM grouped g JOIN decided USING (upload) LEFT JOIN words w ON w.kind = g.kind AND w.fault = g.fault""",
    "order_problems": f"""SELECT upload, order_fault, CASE order_fault WHEN 'contradictory' THEN 'Your dates are written both ways: row ' || d.line || ' has "' || trim(d.date) || '", which can only be day first, and row ' || m.line || ' has "' || trim(m.date) || '", which can only be month first. {fixed.ORDER_ADVICE}'
  ELSE 'Every date in that file could be read two ways — row ' || a.line || '''s "' || trim(a.date) || '" is ' || printf('%04d-%02d-%02d', a.year, a.second, a.first) || ' or ' || printf('%04d-%02d-%02d', a.year, a.first, a.second) || '. {fixed.ORDER_ADVICE}' END AS date_order_problem
FROM decided LEFT JOIN (SELECT * FROM readc) d ON d.upload = decided.upload AND d.line = decided.df LEFT JOIN (SELECT * FROM readc) m ON m.upload = decided.upload AND m.line = decided.mf LEFT JOIN (SELECT * FROM readc) a ON a.upload = decided.upload AND a.line = decided.am
WHERE order_fault IS NOT NULL""".replace("SELECT upload, order_fault", "SELECT decided.upload, order_fault"),
    "accepted": "SELECT upload, line, product_value AS product, resolved_iso AS iso, weight_value AS weight FROM resolved WHERE upload NOT IN (SELECT upload FROM found) AND order_fault IS NULL",
    "months": "SELECT upload, list_sort(list_distinct(list(iso[1:7]))) AS months FROM accepted GROUP BY upload",
}


def sql(query: str) -> str:
    return with_views(query, CTES)


_NUMBER = "CASE WHEN weight = floor(weight) THEN CAST(CAST(weight AS BIGINT) AS VARCHAR) ELSE CAST(weight AS VARCHAR) END"
ORACLE_SQL = {
    "v_product": sql("SELECT upload, line, CASE WHEN NOT long THEN product_value END AS product_value, CASE WHEN long THEN 'too-long' ELSE product_fault END AS product_fault FROM readc"),
    "v_weight": sql("SELECT upload, line, CASE WHEN wf IS NULL THEN CAST(replace(tw, ',', '') AS DOUBLE) END AS weight_value, wf AS weight_fault FROM weights"),
    "v_date": sql("SELECT upload, line, date_kind, date_fault, iso, first, second, year, CASE WHEN date_kind <> 'numeric' THEN NULL WHEN first > 12 THEN 'day-first' WHEN second > 12 THEN 'month-first' END AS proven FROM readc"),
    "v_too_long": sql("SELECT upload, line, 'product' AS columns FROM readc WHERE long"),
    "v_order": sql("SELECT upload, rows_read, date_order, order_fault, df AS day_first_line, mf AS month_first_line, am AS ambiguous_line FROM decided"),
    "v_resolve": sql("SELECT upload, line, resolved_iso, resolved_fault FROM resolved"),
    "v_both_readings": sql("SELECT upload, line, printf('%04d-%02d-%02d', year, second, first) AS day_first, printf('%04d-%02d-%02d', year, first, second) AS month_first FROM readc WHERE date_kind = 'numeric' AND first <= 12 AND second <= 12"),
    "v_accepted": sql("SELECT * FROM accepted"),
    "v_months": sql("SELECT upload, array_to_string(months, ',') AS months FROM months"),
    "v_width": sql("SELECT upload, 'width|' || actual AS key, 'Has ' || actual || ' columns where the header has 3' AS rule, count(*) AS n FROM (SELECT upload, CASE WHEN line % 2 = 0 THEN 2 ELSE 5 END AS actual FROM cells WHERE (upload + line) % 29 = 4) x GROUP BY 1, 2, 3"),
    "v_output_line": sql(f"SELECT upload, line, CASE WHEN regexp_matches(product, '[\",\\n]') THEN '\"' || replace(product, '\"', '\"\"') || '\"' ELSE product END || ',' || iso || ',' || {_NUMBER} AS text FROM accepted"),
    "v_coverage": sql("""SELECT upload, 'Your file has orders in ' || CASE len(m) WHEN 1 THEN m[1] WHEN 2 THEN m[1] || ' and ' || m[2] ELSE array_to_string(m[1:-2], ', ') || ', and ' || m[-1] END || ', but you did not give a count for ' || CASE len(m) WHEN 1 THEN 'that month' ELSE 'those months' END || '.' AS summary,
 'months in the file with no count: ' || array_to_string(m, ', ') AS detail FROM (SELECT upload, [x FOR x IN months IF x[6:7] = '07'] AS m FROM months) a WHERE len(m) > 0"""),
    "f_findings": sql("SELECT upload, key, n, list_aggregate([r.s || '-' || r.e FOR r IN ranges], 'string_agg', ',') AS ranges, array_to_string(examples, '¦') AS examples, first_line, raw FROM grouped"),
    "f_failing_rows": sql("SELECT upload, rows_read, coalesce(failing, 0) AS failing FROM decided LEFT JOIN (SELECT upload, count(DISTINCT line) AS failing FROM found GROUP BY 1) f USING (upload)"),
    "f_problem_words": sql("SELECT upload, key, rule, advice, rows_text, array_to_string(quoted, ' ') AS quoted FROM worded"),
    "f_order_problem": sql("SELECT * FROM order_problems"),
    "f_rejection": sql("""SELECT upload, 'bad_rows' AS reason, 'We found problems in ' || coalesce(failing, 0) || ' of your ' || rows_read || CASE rows_read WHEN 1 THEN ' row.' ELSE ' rows.' END AS summary,
  coalesce(np, 0) AS n_problems, date_order_problem, concat_ws('; ', date_order_problem, lines) AS detail
FROM decided LEFT JOIN (SELECT upload, count(DISTINCT line) AS failing FROM found GROUP BY 1) f USING (upload) LEFT JOIN (SELECT upload, date_order_problem FROM order_problems) o USING (upload)
LEFT JOIN (SELECT upload, count(*) AS np, string_agg(rows_text || ': ' || rule || '.' || CASE len(quoted) WHEN 0 THEN '' WHEN 1 THEN ' For example ' || quoted[1] || '.' ELSE ' For example ' || array_to_string(quoted[1:-2], ', ') || ' and ' || quoted[-1] || '.' END, '; ' ORDER BY first_at) AS lines FROM worded GROUP BY 1) l USING (upload)
WHERE failing IS NOT NULL OR date_order_problem IS NOT NULL"""),
}
