"""Queries of JSON documents and scalar functions, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import fixed, text
from larder.operators import documents, submission
from larder.sources.views import needed, view, with_views

_ID = "0190163d-8694-739b-aea5-966c26f8ad91"
# Documents as SQL text over the views, read alike by Spark and by other engines. {uuid}: an identifier from a number.
_UUID = "concat('0190163d-8694-739b-aea5-', lpad(CAST({} AS STRING), 12, '0'))"
DOCUMENTS = {
    "run_docs": f"""
SELECT id, CASE WHEN id % 41 = 9 THEN concat('[', body, ']') WHEN id % 43 = 9 THEN substr(body, 2) ELSE body END AS text FROM (
  SELECT id, concat('{{"analysisAttemptId": "', CASE WHEN id % 31 = 4 THEN CAST(id AS STRING) ELSE {_UUID.format("id")} END, '", ', CASE WHEN id % 37 = 5 THEN '"extra": 1, ' ELSE '' END,
    '"report": {{"name": "', CASE WHEN id % 29 = 3 THEN '' ELSE name END, '", "siteName": ', CASE id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"S"' ELSE CASE WHEN deleted_at IS NULL THEN '"T"' ELSE '7' END END,
    ', "countsBasis": "', CASE WHEN organization_id = 7 THEN 'cats' ELSE counts_basis END, '", "unitSystem": ', CASE WHEN organization_id = 9 THEN '1' ELSE concat('"', unit_system, '"') END,
    ', "monthlyCounts": {{"', CAST(year(created_at) AS STRING), '-', lpad(CAST(month(created_at) + CASE WHEN id % 23 = 2 THEN 12 ELSE 0 END AS STRING), 2, '0'), '": ',
    CAST(created_by_user_id AS STRING), CASE id % 19 WHEN 1 THEN '.0' WHEN 2 THEN '.5' WHEN 3 THEN ', "2026-01": true' ELSE '' END, '}}}}}}') AS body
  FROM reports) r""",
    "progress_docs": """
SELECT event_id, concat('{"sequence": ', CASE event_type WHEN 'click' THEN concat(CAST(sequence AS STRING), '.0') WHEN 'signup' THEN concat('"', CAST(sequence AS STRING), '"')
  WHEN 'error' THEN concat(CAST(sequence AS STRING), CASE WHEN cancel THEN '.5' ELSE ', "note": 1' END) ELSE CAST(sequence AS STRING) END, '}') AS text FROM heartbeats""",
    "result_docs": f"""
SELECT id, concat('{{"analysisAttemptId": "', {_UUID.format("id")}, '", "charts": [', coalesce(keys, ''), '], "ai": {{"model": ', coalesce(concat('"', ai_model, '"'), 'null'),
  ', "inputTokens": ', coalesce(CAST(ai_input_tokens AS STRING), 'null'), ', "outputTokens": ', CASE WHEN attempt_number = 2 THEN '-1' ELSE coalesce(CAST(ai_output_tokens AS STRING), 'null') END,
  ', "costUsd": ', coalesce(concat('"', CAST(ai_cost_usd AS STRING), '"'), '0.125'), ', "metadata": {{}}}}, "resultMetadata": ', CASE WHEN requested_by_user_id IS NULL THEN '[]' ELSE '{{}}' END, '}}') AS text
FROM attempts LEFT JOIN (SELECT analysis_attempt_id, string_agg(concat('"', chart_key, '"'), ', ') AS keys FROM result_files WHERE chart_key IS NOT NULL GROUP BY analysis_attempt_id) c ON analysis_attempt_id = id""",
    "failure_docs": """
SELECT id, concat('{"reason": ', coalesce(concat('"', failure_reason, '"'), 'null'), ', "detail": "', coalesce(worker_id, ''), '", "traceback": ',
  CASE WHEN status = 'canceled' THEN CAST(id AS STRING) ELSE coalesce(concat('"', CAST(requested_by_user_id AS STRING), '"'), 'null') END, '}') AS text FROM attempts""",
}


def _docs(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The documents of one kind, one for each row they are written from."""
    sql = DOCUMENTS[name]
    names = needed(sql)
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}} {n}", text)
    return spark.sql(text, **{n: view(spark, d, n) for n in names})


def j_run(spark: SparkSession, d: str) -> DataFrame:
    """A run manifest for every report."""
    return documents.check_run(_docs(spark, d, "run_docs")).select("id", "message")


def j_progress(spark: SparkSession, d: str) -> DataFrame:
    """A progress document for every heartbeat."""
    return documents.check_progress(_docs(spark, d, "progress_docs")).select("event_id", "message")


def j_result(spark: SparkSession, d: str) -> DataFrame:
    """A result document for every attempt; those that did not succeed lack the model, tokens and cost."""
    return documents.check_result(_docs(spark, d, "result_docs")).select("id", "message")


def j_failure(spark: SparkSession, d: str) -> DataFrame:
    """A failure document for every attempt, whatever its reason."""
    return documents.check_failure(_docs(spark, d, "failure_docs")).select("id", "message")


def j_payload(spark: SparkSession, d: str) -> DataFrame:
    """Result documents written from rows and checked again: none has an issue."""
    a = view(spark, d, "attempts").where("ai_model IS NOT NULL").withColumns({"uuid": F.lit(_ID), "charts": F.array(F.lit("by_month"))})
    return documents.check_result(documents.result_payload(a)).select("id", "message", F.get_json_object("text", "$.ai.costUsd").alias("cost"))


def j_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Run documents written from rows and checked again: none has an issue."""
    r = view(spark, d, "reports").withColumns({"uuid": F.lit(_ID), "site_name": F.when(F.col("id") % 2 == 0, F.concat(F.lit("Site "), "name")), "monthly_counts": F.create_map(F.date_format("created_at", "yyyy-MM"), F.col("id"))})
    return documents.check_run(documents.run_manifest(r)).select("id", "message", F.get_json_object("text", "$.report.siteName").alias("site"), F.get_json_object("text", "$.report.monthlyCounts").alias("counts"))


def t_filenames(spark: SparkSession, d: str) -> DataFrame:
    """Long names, each with as many characters of two units ahead as its turn says, cut by units."""
    c = view(spark, d, "conversations").select("conv_id", "turn", F.concat(F.repeat(F.lit("😀"), F.col("turn").cast("int") * 21), "text").alias("name"))
    cut = submission.stored_filename(F.col("name"))
    return c.select("conv_id", "turn", F.length(cut).cast("long").alias("characters"), text.utf16_length(cut).cast("long").alias("units"))


def t_formats(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "result_files").select("id", text.file_extension(F.col("kind")).alias("extension"), text.content_type(F.col("kind")).alias("content_type"))


def v_site(spark: SparkSession, d: str) -> DataFrame:
    """Site names of forms: trimmed, a blank one is null."""
    r = view(spark, d, "reports").withColumn("site_name", F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), "name", F.lit(" "))).when(F.col("id") % 3 == 1, " \t"))
    return submission.check_metadata(r.withColumn("counts", F.lit('{"2026-01": 1}'))).select("id", "site", F.array_join("bad_fields", ",").alias("bad_fields"))


# A hierarchy of error classes: five at the top, then each supplier's below that of a quarter of its number; some have a second parent.
_CLASSES = """
SELECT CASE s_suppkey WHEN 1 THEN 'UpstreamApiError' WHEN 2 THEN 'UnusableDataError' WHEN 3 THEN 'InvalidInputError' WHEN 4 THEN 'ContractError' ELSE concat('E', CAST(s_suppkey AS STRING)) END AS class,
  CASE WHEN s_suppkey > 5 THEN CASE CAST(floor(s_suppkey / 4) AS INT) WHEN 1 THEN 'UpstreamApiError' WHEN 2 THEN 'UnusableDataError' WHEN 3 THEN 'InvalidInputError' WHEN 4 THEN 'ContractError' ELSE concat('E', CAST(CAST(floor(s_suppkey / 4) AS INT) AS STRING)) END END AS parent FROM supplier
UNION ALL SELECT concat('E', CAST(s_suppkey AS STRING)), CASE WHEN s_suppkey % 2 = 0 THEN 'UnusableDataError' ELSE 'ContractError' END FROM supplier WHERE s_suppkey > 5 AND s_suppkey % 5 = 2"""
_ERRORS = "SELECT event_id, concat('E', CAST(user_id % 60 AS STRING)) AS class, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('error ', CAST(event_id AS STRING)) END AS message FROM events WHERE event_type = 'error'"


def j_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What a child reports for every error, by the ancestors of its class."""
    sql = lambda text, t: spark.sql(text.replace(f"FROM {t}", f"FROM {{{t}}}"), **{t: view(spark, d, t)})
    return documents.child_reasons(sql(_ERRORS, "events"), sql(_CLASSES, "supplier")).select("event_id", "reason", "detail")


def t_words(spark: SparkSession, d: str) -> DataFrame:
    """Trim, lengths, file names and cut names on whole messy texts."""
    c = view(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("raw"))
    return c.select(
        "conv_id", "turn", text.utf16_length(F.col("raw")).cast("long").alias("units"), F.length(text.trim(F.col("raw"))).cast("long").alias("trimmed"),
        F.length(submission.stored_filename(F.col("raw"))).cast("long").alias("name_length"), text.capitalize(F.lower("raw")).alias("capitalized"),
    )


def t_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text and grouped."""
    li = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", text.number_text(F.col("l_quantity")).alias("quantity"), text.group_digits(F.floor("l_extendedprice")).alias("grouped"))


def t_links(spark: SparkSession, d: str) -> DataFrame:
    """Keys, links and headers for each input file."""
    f = view(spark, d, "input_files")
    org = F.col("id") % 25
    return f.select(
        "id", text.storage_key(org.cast("string"), F.lit("report"), F.col("report_id").cast("string")).alias("key"), text.report_url("https://x", org.cast("string"), F.col("report_id").cast("string")).alias("url"),
        text.content_disposition(F.col("original_filename")).alias("header"), text.chart_file(F.concat(F.lit("k_"), F.col("id").cast("string"))).alias("chart"),
    )


def t_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Version 7 identifiers made from event times, decoded back to the millisecond."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    h = F.lpad(F.lower(F.hex(ms)), 12, "0")
    e = view(spark, d, "events").select("event_id", "ts", F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7abc-8def-"), F.lpad(F.lower(F.hex("event_id")), 12, "0")).alias("u"))
    return e.select("event_id", F.unix_millis(text.uuid_time(F.col("u"))).alias("ms"), text.is_uuid(F.col("u")).alias("valid"), text.uuid_version(F.col("u")).alias("version"))


def v_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Form fields of every report, some damaged: all bad fields are named."""
    r = view(spark, d, "reports")
    forms = r.select(
        "id", F.when(F.col("id") % 7 == 1, "  ").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 11 == 2, F.lit("s" * 201)).alias("site_name"),
        F.when(F.col("id") % 13 == 3, "cats").otherwise(F.col("counts_basis")).alias("counts_basis"), "unit_system",
        F.when(F.col("id") % 5 == 4, '{"2026-01": true}').when(F.col("id") % 17 == 5, '{"2026-13": 3}').when(F.col("id") % 19 == 6, "{}").otherwise('{"2026-01": 120, "2026-02": 3.0}').alias("counts"),
    )
    return submission.check_metadata(forms).select("id", F.array_join("bad_fields", ",").alias("bad_fields"))


QUERIES = {f.__name__: f for f in (j_run, j_progress, j_result, j_failure, j_payload, j_reasons, j_manifest, t_filenames, t_formats, v_site, t_words, t_numbers, t_links, t_uuid, v_metadata)}


def _said(key: str, source: str, faults: list[tuple[str, str]], broken: str = "false") -> str:
    """The expected message: of each fault whose condition on the source's columns holds, in order."""
    parts = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in faults)
    return f"SELECT {key}, CASE WHEN {broken} THEN '$: expected a JSON object' ELSE concat_ws('; ', {parts}) END AS message FROM {source}"


_CHILD = ", ".join(f"'{r}'" for r in documents.CHILD_REASONS)
_WHOLE = "sequence: expected a whole number of 1 or more"
_SQL = {
    "j_run": _said("id", "reports", [
        ("id % 37 = 5", "$: unknown field"), ("id % 31 = 4", "analysisAttemptId: expected a UUID"), ("id % 29 = 3", "report.name: expected text or null"),
        ("id % 3 = 2 AND deleted_at IS NOT NULL", "report.siteName: expected text or null"), ("organization_id = 7", "report.countsBasis: not in the vocabulary"),
        ("organization_id = 9", "report.unitSystem: not in the vocabulary"), ("id % 23 = 2 OR id % 19 IN (2, 3)", "report.monthlyCounts: expected whole numbers by month"),
    ], "id % 41 = 9 OR id % 43 = 9"),
    "j_progress": _said("event_id", "heartbeats", [("event_type = 'error' AND NOT cancel", "$: unknown field"), ("event_type = 'signup' OR cancel OR sequence < 1", _WHOLE)]),
    "j_result": _said("id", "attempts", [
        ("id IN (SELECT analysis_attempt_id FROM result_files WHERE chart_key IS NOT NULL GROUP BY analysis_attempt_id HAVING count(*) > count(DISTINCT chart_key))", "charts: expected distinct snake_case keys"),
        ("ai_model IS NULL", "ai.model: expected text"), ("ai_input_tokens IS NULL", "ai.inputTokens: expected a whole number"), ("ai_output_tokens IS NULL OR attempt_number = 2", "ai.outputTokens: expected a whole number"),
        ("ai_cost_usd IS NULL", "ai.costUsd: expected a cost with four places"), ("requested_by_user_id IS NULL", "resultMetadata: expected a JSON object"),
    ]),
    "j_failure": _said("id", "attempts", [
        (f"failure_reason IS NULL OR failure_reason NOT IN ({_CHILD})", "reason: not a reason the child may claim"), ("worker_id IS NULL", "detail: expected text"), ("status = 'canceled'", "traceback: expected text or null"),
    ]),
    "j_reasons": f"""WITH RECURSIVE classes AS ({_CLASSES}), up AS (SELECT class, class AS ancestor FROM classes UNION SELECT u.class, parent FROM up u JOIN classes c ON u.ancestor = c.class WHERE parent IS NOT NULL)
SELECT event_id, coalesce(reason, 'unknown') AS reason, CASE WHEN message = '' THEN class || '()' ELSE message END AS detail FROM ({_ERRORS}) e
 LEFT JOIN (SELECT class, ['upstream_api', 'unusable_data', 'contract_violation', 'contract_violation'][min(list_position({list(fixed.CHILD_ERRORS)}, ancestor))] AS reason FROM up WHERE ancestor IN ({", ".join(f"'{c}'" for c in fixed.CHILD_ERRORS)}) GROUP BY 1) r USING (class)""",
    "j_manifest": "SELECT id, '' AS message, CASE WHEN id % 2 = 0 THEN 'Site ' || name END AS site, '{\"' || strftime(created_at, '%Y-%m') || '\":' || id || '}' AS counts FROM reports",
    "t_filenames": "SELECT conv_id, turn, CASE WHEN n >= 255 THEN 127 ELSE 21 * turn + least(length(text), 255 - n) END AS characters, CASE WHEN n >= 255 THEN 254 ELSE n + least(length(text), 255 - n) END AS units FROM (SELECT *, 42 * turn AS n FROM conversations) c",
    "t_formats": "SELECT id, " + " ".join(["CASE kind", *[f"WHEN '{k}' THEN '{e}'" for k, (e, _) in fixed.RESULT_KINDS.items()], "END AS extension, CASE kind", *[f"WHEN '{k}' THEN '{t}'" for k, (_, t) in fixed.RESULT_KINDS.items()], "END AS content_type FROM result_files"]),
    "v_site": "SELECT id, CASE WHEN id % 3 = 0 THEN name END AS site, '' AS bad_fields FROM reports",
    "j_payload": "SELECT id, '' AS message, CAST(ai_cost_usd AS VARCHAR) AS cost FROM attempts WHERE ai_model IS NOT NULL",
    "t_words": "SELECT conv_id, turn, length(text) AS units, length(trim(text, chr(10) || chr(9) || ' ')) AS trimmed, least(length(text), 255) AS name_length, upper(text[1:1]) || lower(text[2:]) AS capitalized FROM conversations",
    "t_numbers": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS grouped FROM lineitem",
    "t_links": "SELECT id, concat('org/', id % 25, '/report/', report_id) AS key, concat('https://x/orgs/', id % 25, '/reports/', report_id) AS url, 'attachment; filename=\"' || original_filename || '\"; filename*=UTF-8''''' || replace(original_filename, ' ', '%20') AS header, 'chart-k_' || id || '.png' AS chart FROM input_files",
    "t_uuid": "SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS valid, 7 AS version FROM events",
    "v_metadata": "SELECT id, array_to_string(list_filter([CASE WHEN id % 7 = 1 THEN 'name' END, CASE WHEN id % 11 = 2 THEN 'siteName' END, CASE WHEN id % 13 = 3 THEN 'countsBasis' END, CASE WHEN id % 5 = 4 OR id % 17 = 5 OR id % 19 = 6 THEN 'monthlyCounts' END], lambda x: x IS NOT NULL), ',') AS bad_fields FROM reports",
}
ORACLE_SQL = {k: v if v.startswith("WITH RECURSIVE") else with_views(v) for k, v in _SQL.items()}
