"""Queries of the attempt lifecycle, notifications and audits over the derived tables, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators import audit, lifecycle
from larder.sources.views import NOW, view, with_views

TS = f"TIMESTAMP '{NOW}'"
SITE, SUPPORT, APP = "https://app.example.org", "help@example.org", "Larder"


def s(name: str) -> Column:
    """A moment or number as text, the same in either engine."""
    return F.col(name).cast("string").alias(name)


def a_claim(spark: SparkSession, d: str) -> DataFrame:
    got = lifecycle.claim(view(spark, d, "attempts"), NOW, "w9", 25)
    return got.select("id", "report_id", "status", "worker_id", s("claimed_at"))


def a_inputs(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.load_inputs(view(spark, d, "attempts"), view(spark, d, "reports"), view(spark, d, "input_files"))


def _beats(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "attempts").where(F.col("worker_id").isNotNull() & F.col("status").isin("processing", "failed"))
    return a.select("id", F.when(F.col("id") % 13 == 0, "w0").otherwise(F.col("worker_id")).alias("worker_id"))


def a_renew(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.renew(_beats(spark, d), view(spark, d, "attempts")).select("id", "worker_id", "lease", s("cancel_requested_at"))


def a_terminal(spark: SparkSession, d: str) -> DataFrame:
    verdicts = _beats(spark, d).withColumn("verdict", F.when(F.col("id") % 2 == 0, "failed").otherwise("succeeded")).withColumn("reason", F.lit("unknown"))
    got = lifecycle.settle_verdicts(verdicts, view(spark, d, "attempts"), NOW)
    return got.select("id", "worker_id", "won", "status", "failure_reason", s("finished_at"))


def a_expired(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "attempts")
    return a.where((F.col("status") == "processing") & lifecycle.is_expired("2011-01-01 00:00:00")).select("id", s("lease_renewed_at"))


def a_reap(spark: SparkSession, d: str) -> DataFrame:
    got = lifecycle.reap(view(spark, d, "attempts"), NOW, "w7", 50)
    return got.select("id", "status", "failure_reason", "failure_detail", s("finished_at"), "reaped_by_worker_id")


def a_cancel(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cancel_requested(view(spark, d, "attempts"), NOW).select("id", "status", s("finished_at"))


def _endings(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    pick = lambda col, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(col) % len(v) + 1).cast("int"))
    o = o.withColumns({"x": F.floor(F.col("id") / 3), "y": F.floor(F.col("id") / 12), "z": F.floor(F.col("id") / 60)})
    return o.select(
        "id", pick("id", "exited", "exited", "signaled").alias("outcome"), pick("x", 0, 1, 2, 7).alias("exit_code"), F.lit("SIGKILL").alias("signal"),
        F.when(F.col("id") % 4 == 0, "tail of stderr").otherwise("").alias("stderr"), pick("y", "result", "failure", "contract-error", "read-error", "not-read").alias("read"),
        F.lit("upstream_api").alias("read_reason"), F.lit("what was read").alias("read_detail"),
        F.when(F.col("id") % 5 == 0, F.array(F.lit("report.pdf"))).otherwise(F.array().cast("array<string>")).alias("missing"),
        pick("z", "none", "none", "none", "fenced", "canceled", "hung", "hard-timeout", "shutting-down", "contract-violation").alias("kill"), F.lit("bad progress").alias("kill_detail"),
    )


def a_verdict(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.classify_endings(_endings(spark, d)).select("id", "verdict", "reason", "detail")


def a_errors(spark: SparkSession, d: str) -> DataFrame:
    codes = ["08006", "40001", "23505", "ECONNRESET", "57P01", "42P01"]
    e = view(spark, d, "events").where("event_type = 'error'")
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % len(v) + 1).cast("int"))
    e = e.select("event_id", pick(["database", "blob-store", "other", "database", "database"]).alias("source"), pick(codes).alias("code"), pick([*fixed.TRANSIENT_MESSAGES, "refused", "no such key"]).alias("message"))
    return lifecycle.classify_errors(e).select("event_id", "transient", "reason", "detail")


def a_apply(spark: SparkSession, d: str) -> DataFrame:
    """Canceled pending attempts written back; every third change was read before another writer took the row."""
    a = view(spark, d, "attempts")
    changes = lifecycle.cancel_requested(a, NOW).select("id", F.when(F.col("id") % 3 == 0, "processing").otherwise("pending").alias("was"), "status")
    return lifecycle.apply_changes(a.select("id", F.col("status").alias("was"), "status"), changes, "id", "was").select("id", "status")


def a_explain(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.explain(view(spark, d, "attempts")).select("id", "what_happened", "follow_up", "follow_up_text")


def a_claimants(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "attempts").where("failure_reason IS NOT NULL")
    claims = a.select("id", F.col("failure_reason").alias("reason"), F.when(F.floor(F.col("id") / 10) % 2 == 0, "child").otherwise("parent").alias("claimed_by"))
    return lifecycle.wrong_claimants(claims).select("id", "reason", "claimed_by")


def a_missing_files(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "result_files")
    written = f.select(F.col("analysis_attempt_id").alias("id"), F.when(F.col("kind") == "chart", F.concat(F.lit("chart-"), "chart_key", F.lit(".png"))).otherwise(F.concat(F.lit("report."), "kind")).alias("file"))
    declared = f.select(F.col("analysis_attempt_id").alias("id")).distinct().withColumn("charts", F.array(F.lit("by_month"), F.lit("top_products")))
    return lifecycle.missing_files(declared, written).select("id", F.array_join("missing", ",").alias("missing"))


def a_integrity(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("content"))
    files = docs.select(
        F.col("key").alias("storage_key"), (F.length("content") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("byte_size"),
        F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")), 256).alias("checksum"),
    )
    return lifecycle.input_faults(files, docs).select("storage_key", "fault")


def a_parked(spark: SparkSession, d: str) -> DataFrame:
    h = view(spark, d, "heartbeats").select("event_id", F.when(F.col("event_id") % 2 == 0, "upload").otherwise("write").alias("stage"), F.col("ts").alias("since"),
        F.when(F.col("event_id") % 5 == 0, "lost").otherwise("held").alias("lease"), F.when(F.col("cancel"), F.col("ts")).alias("cancel_requested_at"))
    return lifecycle.decide_parked(h, "2024-01-15 00:00:00").select("event_id", "action")


def n_due(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "attempts").where(lifecycle.is_due(NOW)).select("id", "status", "notification_attempts")


def n_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = lifecycle.due_notifications(view(spark, d, "attempts"), view(spark, d, "reports"), NOW, "w3", 40)
    return got.select("id", "report_id", "notification_attempts", "notification_claimed_by_worker_id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    due = view(spark, d, "attempts").where(lifecycle.is_due(NOW))
    return lifecycle.load_messages(due, view(spark, d, "reports"), view(spark, d, "users"), view(spark, d, "result_files"))


def n_load(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", "email", "report_name", "pdf_id", "xlsx_id")


def n_outbox(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.outbox(_messages(spark, d), SITE, SUPPORT, APP)


def n_invites(spark: SparkSession, d: str) -> DataFrame:
    """Invitations, a third of them from users who are gone."""
    i = view(spark, d, "invites").withColumn("invited_by_user_id", F.col("id") + F.when(F.col("id") % 3 == 1, 10_000_000).otherwise(0))
    return lifecycle.invite_messages(i, view(spark, d, "orgs"), view(spark, d, "users"), SITE, APP)


def n_notices(spark: SparkSession, d: str) -> DataFrame:
    """A notice for each organization that is made or goes, and for each user who goes."""
    u = view(spark, d, "users").select(F.col("id").alias("who"), F.col("email").alias("actor_email"))
    o = view(spark, d, "orgs").join(u, F.col("created_by_user_id") == F.col("who"))
    made = o.select("id", F.when(F.col("id") % 2 == 0, "organization-created").otherwise("organization-deleted").alias("what"), "name", "actor_email")
    gone = u.select(F.col("who").alias("id"), F.lit("user-deleted").alias("what"), F.col("actor_email").alias("name"), F.lit(None).cast("string").alias("actor_email"))
    return lifecycle.notices(made.unionByName(gone), "ops", "ops@example.org", APP)


def n_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Sent stamps, written only where none is yet."""
    a = view(spark, d, "attempts").where("finished_at IS NOT NULL").select("id", F.col("notification_email_sent_at").alias("was"), F.col("notification_email_sent_at").alias("sent_at"))
    changes = a.select("id", F.lit(None).cast("timestamp").alias("was"), lifecycle.moment(NOW).alias("sent_at"))
    return lifecycle.apply_changes(a, changes, "id", "was").select("id", s("sent_at"))


def n_window(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "attempts").where("notification_attempts > 0")
    return a.select("id", lifecycle.retry_window(F.col("notification_attempts")).alias("seconds"))


def i_checks(spark: SparkSession, d: str) -> DataFrame:
    found = [audit.violations(view(spark, d, "attempts"), "attempts", audit.ATTEMPT_CHECKS)]
    more = {"kept_inputs": {"checksum": F.unhex(F.when(F.col("cut"), F.substring(F.repeat("sha", 2), 1, 62)).otherwise(F.repeat("sha", 2)))}}
    found += [audit.violations(view(spark, d, t).withColumns(more.get(t, {})), t, c) for t, c in audit.OTHER_CHECKS.items()]
    return reduce(DataFrame.unionByName, found)


VOCABULARIES = audit.vocabularies("ops_manual")


def i_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """All vocabularies over the audited tables."""
    return reduce(DataFrame.unionByName, [audit.outside_vocabularies(view(spark, d, f"kept_{t}"), t, columns) for t, columns in VOCABULARIES.items()])


def i_unique(spark: SparkSession, d: str) -> DataFrame:
    """All primary keys, unique columns and partial indexes over the audited tables."""
    return reduce(DataFrame.unionByName, [audit.duplicates(view(spark, d, f"kept_{t}"), t, rules) for t, rules in audit.UNIQUE.items()])


def i_foreign(spark: SparkSession, d: str) -> DataFrame:
    """All fifteen edges over the audited tables, against all parents."""
    return audit.orphans({t: view(spark, d, f"kept_{t}") for t in [*audit.EDGES, "accounts"]}, audit.EDGES)


def i_retry(spark: SparkSession, d: str) -> DataFrame:
    return audit.retry_faults(view(spark, d, "attempts"))


def i_frozen(spark: SparkSession, d: str) -> DataFrame:
    old = view(spark, d, "attempts").select("id", "status", "failure_reason", "worker_id", "notification_attempts")
    new = old.where("id % 211 <> 0").withColumns({"worker_id": F.when(F.col("id") % 101 == 0, "w8").otherwise(F.col("worker_id")), "notification_attempts": F.col("notification_attempts") + 1})
    return audit.changed_when_frozen(old, new, ["notification_attempts"])


def i_append(spark: SparkSession, d: str) -> DataFrame:
    old = view(spark, d, "events").select("event_id", "event_type", "user_id")
    new = old.where("event_id % 503 <> 2").withColumn("event_type", F.when(F.col("event_id") % 307 == 1, "other").otherwise(F.col("event_type")))
    return audit.trail_faults(old, new, "event_id")


def i_admins(spark: SparkSession, d: str) -> DataFrame:
    return audit.without_admin(view(spark, d, "orgs"), view(spark, d, "members"))


def i_counters(spark: SparkSession, d: str) -> DataFrame:
    return audit.low_counters(view(spark, d, "users"), view(spark, d, "orgs"))


def i_no_input(spark: SparkSession, d: str) -> DataFrame:
    """Reports without an input file."""
    files = view(spark, d, "input_files").select(F.col("report_id").alias("id"))
    return view(spark, d, "reports").join(files, "id", "left_anti").select("id")


def i_deleted_retry(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "reports").where("deleted_at IS NOT NULL").select(F.col("id").alias("report_id"), "deleted_at")
    return view(spark, d, "attempts").join(r, "report_id").where(F.col("created_at") > F.col("deleted_at")).select("id", "report_id")


def i_objects(spark: SparkSession, d: str) -> DataFrame:
    return audit.dangling(view(spark, d, "input_files"), view(spark, d, "objects"))


def i_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.wrong_keys(view(spark, d, "input_files"), view(spark, d, "reports"))


def i_result_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.wrong_result_keys(view(spark, d, "stored_results"), view(spark, d, "attempts"), view(spark, d, "reports"))


QUERIES = {
    f.__name__: f
    for f in (
        a_claim, a_inputs, a_renew, a_terminal, a_expired, a_reap, a_cancel, a_verdict, a_errors, a_apply, a_explain, a_claimants, a_missing_files, a_integrity, a_parked,
        n_due, n_candidates, n_load, n_outbox, n_invites, n_notices, n_stamp, n_window, i_checks, i_vocabulary, i_unique, i_foreign, i_retry, i_frozen, i_append, i_admins, i_counters, i_no_input,
        i_deleted_retry, i_objects, i_keys, i_result_keys,
    )
}


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in rows) + f") v({names})"


_BEATS = "(SELECT id, CASE WHEN id % 13 = 0 THEN 'w0' ELSE worker_id END AS worker_id FROM attempts WHERE worker_id IS NOT NULL AND status IN ('processing', 'failed')) b"
_OWN = "(SELECT id, worker_id, cancel_requested_at, lease_renewed_at, true AS own FROM attempts WHERE status = 'processing') o USING (id, worker_id)"
_DUE = f"""finished_at IS NOT NULL AND status <> 'canceled' AND notification_email_sent_at IS NULL AND notification_attempts < 5
  AND (notification_claimed_at IS NULL OR notification_claimed_at < {TS} - to_seconds(300 * pow(2, notification_attempts - 1)))"""
_LOADED = f"""(SELECT a.*, email, r.name AS report_name, organization_id, pdf_id, xlsx_id FROM attempts a JOIN reports r ON r.id = report_id JOIN users u ON u.id = requested_by_user_id
 LEFT JOIN (SELECT analysis_attempt_id, min(id) FILTER (kind = 'pdf') AS pdf_id, min(id) FILTER (kind = 'xlsx') AS xlsx_id FROM result_files GROUP BY 1) f ON f.analysis_attempt_id = a.id
 WHERE {_DUE.replace('status', 'a.status')} AND (a.status <> 'succeeded' OR (pdf_id IS NOT NULL AND xlsx_id IS NOT NULL))) l"""
_SAID = "(SELECT * FROM " + _values([(r, *v) for r, v in fixed.FAILURE_EXPLANATIONS.items()], "failure_reason, what_happened, follow_up, follow_up_text") + ") x"


def _checks(table: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, '{table}' AS \"table\", CAST(id AS VARCHAR) AS key FROM {table} WHERE NOT coalesce(({c}), true)" for n, c in checks.items())


def _KEY(table: str) -> str:  # noqa: N802
    return "concat(user_id, '|', organization_id)" if table == "members" else "CAST(id AS VARCHAR)"


def _pick(e: str, *v) -> str:
    return "[" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in v) + f"][CAST({e} % {len(v)} AS INT) + 1]"


_ENDINGS = f"""(SELECT o_orderkey AS id, {_pick('o_orderkey', 'exited', 'exited', 'signaled')} AS outcome, {_pick('(o_orderkey // 3)', 0, 1, 2, 7)} AS code,
 CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'tail of stderr' ELSE '' END AS tail, {_pick('(o_orderkey // 12)', 'result', 'failure', 'contract-error', 'read-error', 'not-read')} AS read,
 o_orderkey % 5 = 0 AS miss, {_pick('(o_orderkey // 60)', 'none', 'none', 'none', 'fenced', 'canceled', 'hung', 'hard-timeout', 'shutting-down', 'contract-violation')} AS kill FROM orders) e"""
_VERDICT = """CASE WHEN kill = 'fenced' THEN 'unowned||' WHEN kill = 'canceled' THEN 'canceled||' WHEN outcome = 'exited' AND code = 0 AND read = 'result' AND NOT miss THEN 'succeeded||'
 WHEN outcome = 'exited' AND code = 1 AND read = 'failure' THEN 'failed|upstream_api|what was read' WHEN kill = 'hung' THEN 'failed|hung|no progress within the allotted time'
 WHEN kill = 'hard-timeout' THEN 'failed|hard_timeout|exceeded the hard ceiling' WHEN kill = 'shutting-down' THEN 'failed|shut_down|killed while the worker was shutting down'
 WHEN kill = 'contract-violation' THEN 'failed|contract_violation|bad progress' WHEN read = 'contract-error' THEN 'failed|contract_violation|what was read' WHEN read = 'read-error' THEN 'failed|infrastructure|what was read'
 WHEN outcome = 'exited' AND code = 0 THEN CASE WHEN read = 'result' THEN 'failed|contract_violation|result.json declared file(s) never written: report.pdf' ELSE 'failed|contract_violation|exited 0 without writing result.json' END
 WHEN outcome = 'exited' AND code = 1 THEN 'failed|contract_violation|exited 1 without writing failure.json' WHEN outcome = 'exited' AND code = 2 THEN 'failed|contract_violation|invoked with the wrong arguments' || tail
 WHEN outcome = 'signaled' THEN 'failed|child_crashed|killed by signal SIGKILL' || tail ELSE 'failed|child_crashed|exited with code ' || code || tail END"""
_CODES = ["08006", "40001", "23505", "ECONNRESET", "57P01", "42P01"]
_ERRORS = f"""(SELECT event_id, {_pick('event_id', 'database', 'blob-store', 'other', 'database', 'database')} AS source, {_pick('event_id', *_CODES)} AS code,
 {_pick('event_id', *fixed.TRANSIENT_MESSAGES, 'refused', 'no such key')} AS message FROM events WHERE event_type = 'error') e"""
_TRANSIENT = f"(source = 'database' AND (starts_with(code, '08') OR code IN ({', '.join(map(_q, fixed.TRANSIENT_SQL_STATES + fixed.TRANSIENT_SYSCALLS))}) OR message IN ({', '.join(map(_q, fixed.TRANSIENT_MESSAGES))})))"
_NAMES = "(SELECT analysis_attempt_id AS id, CASE kind WHEN 'chart' THEN 'chart-' || chart_key || '.png' ELSE 'report.' || kind END AS file FROM result_files) w"

_SQL = {
    "a_claim": f"SELECT id, report_id, 'processing' AS status, 'w9' AS worker_id, '{NOW}' AS claimed_at FROM attempts WHERE status = 'pending' AND cancel_requested_at IS NULL ORDER BY created_at, id LIMIT 25",
    "a_inputs": "SELECT a.id, a.report_id, status, organization_id, r.name AS report_name, counts_basis, unit_system, f.id AS input_file_id, storage_key, byte_size, f.id IS NULL AS missing_input FROM attempts a JOIN reports r ON r.id = a.report_id LEFT JOIN input_files f ON f.report_id = a.report_id",
    "a_renew": f"SELECT id, worker_id, CASE WHEN own THEN 'held' ELSE 'lost' END AS lease, CAST(cancel_requested_at AS VARCHAR) AS cancel_requested_at FROM {_BEATS} LEFT JOIN {_OWN}",
    "a_terminal": f"SELECT id, worker_id, coalesce(own, false) AS won, CASE WHEN own THEN CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'succeeded' END END AS status, CASE WHEN own AND id % 2 = 0 THEN 'unknown' END AS failure_reason, CASE WHEN own THEN CAST(greatest({TS}, lease_renewed_at) AS VARCHAR) END AS finished_at FROM {_BEATS} LEFT JOIN {_OWN}",
    "a_expired": "SELECT id, CAST(lease_renewed_at AS VARCHAR) AS lease_renewed_at FROM attempts WHERE status = 'processing' AND (coalesce(lease_renewed_at < TIMESTAMP '2011-01-01 00:00:00' - INTERVAL 180 SECOND, false) OR coalesce(claimed_at < TIMESTAMP '2011-01-01 00:00:00' - INTERVAL 1800 SECOND, false))",
    "a_reap": f"SELECT id, CASE WHEN cancel_requested_at IS NULL THEN 'failed' ELSE 'canceled' END AS status, CASE WHEN cancel_requested_at IS NULL THEN 'abandoned' END AS failure_reason, CASE WHEN cancel_requested_at IS NULL THEN 'lease of ' || coalesce(worker_id, 'nobody') || ' expired' END AS failure_detail, CAST(greatest({TS}, lease_renewed_at) AS VARCHAR) AS finished_at, 'w7' AS reaped_by_worker_id FROM attempts WHERE status = 'processing' AND (coalesce(lease_renewed_at < {TS} - INTERVAL 180 SECOND, false) OR coalesce(claimed_at < {TS} - INTERVAL 1800 SECOND, false)) ORDER BY lease_renewed_at NULLS LAST, id LIMIT 50",
    "a_cancel": f"SELECT id, 'canceled' AS status, CAST(greatest({TS}, cancel_requested_at) AS VARCHAR) AS finished_at FROM attempts WHERE status = 'pending' AND cancel_requested_at IS NOT NULL",
    "a_verdict": f"SELECT id, v[1] AS verdict, nullif(v[2], '') AS reason, CASE WHEN v[1] = 'failed' THEN v[3] END AS detail FROM (SELECT id, string_split({_VERDICT}, '|') AS v FROM {_ENDINGS}) x",
    "a_errors": f"SELECT event_id, {_TRANSIENT} AS transient, CASE WHEN source = 'other' THEN 'unknown' ELSE 'infrastructure' END AS reason, CASE WHEN {_TRANSIENT} THEN 'Could not reach the database: ' || message WHEN source = 'database' THEN 'The database refused a statement (SQLSTATE ' || code || '): ' || message WHEN source = 'blob-store' THEN 'Could not reach the blob store: ' || message ELSE message END AS detail FROM {_ERRORS}",
    "a_apply": "SELECT id, CASE WHEN status = 'pending' AND cancel_requested_at IS NOT NULL AND id % 3 <> 0 THEN 'canceled' ELSE status END AS status FROM attempts",
    "a_explain": f"SELECT id, what_happened, follow_up, follow_up_text FROM attempts JOIN {_SAID} USING (failure_reason)",
    "a_claimants": "SELECT id, failure_reason AS reason, claimed_by FROM (SELECT id, failure_reason, CASE WHEN (id // 10) % 2 = 0 THEN 'child' ELSE 'parent' END AS claimed_by FROM attempts WHERE failure_reason IS NOT NULL) c JOIN " + _values(list(fixed.FAILURE_CLAIMANTS.items()), "failure_reason, claimant") + " USING (failure_reason) WHERE claimant <> 'either' AND claimant <> claimed_by",
    "a_missing_files": f"SELECT id, string_agg(file, ',' ORDER BY file) AS missing FROM (SELECT DISTINCT analysis_attempt_id AS id, unnest(['report.pdf', 'report.xlsx', 'chart-by_month.png', 'chart-top_products.png']) AS file FROM result_files) d ANTI JOIN {_NAMES} USING (id, file) GROUP BY id",
    "a_integrity": "SELECT CAST(doc_id AS VARCHAR) AS storage_key, CASE WHEN doc_id % 7 = 0 THEN 'size' ELSE 'checksum' END AS fault FROM documents WHERE doc_id % 7 = 0 OR doc_id % 10 = 3",
    "a_parked": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'drop-parked-verdict' WHEN cancel THEN 'convert-parked-verdict-to-canceled' WHEN event_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 300 SECOND THEN 'convert-parked-verdict-to-upload-expired' ELSE 'resume-parked-verdict' END AS action FROM heartbeats",
    "n_due": f"SELECT id, status, notification_attempts FROM attempts WHERE {_DUE}",
    "n_candidates": f"SELECT a.id, report_id, notification_attempts + 1 AS notification_attempts, 'w3' AS notification_claimed_by_worker_id FROM attempts a JOIN reports r ON r.id = report_id AND deleted_at IS NULL WHERE {_DUE} AND requested_by_user_id IS NOT NULL ORDER BY finished_at, a.id LIMIT 40",
    "n_load": f"SELECT id, email, report_name, pdf_id, xlsx_id FROM {_LOADED}",
    "n_outbox": f"""SELECT id AS attempt_id, CASE status WHEN 'succeeded' THEN 'analysis-succeeded' ELSE 'analysis-failed' END AS kind, email AS recipient, subject,
 concat_ws(chr(10) || chr(10), subject, CASE WHEN status = 'succeeded' THEN concat_ws(chr(10) || chr(10), 'We have finished analysing your procurement data.', 'View your report: ' || url, 'Download the PDF: {SITE}/file/result/' || pdf_id || chr(10) || 'Download the Excel sheet: {SITE}/file/result/' || xlsx_id)
 ELSE concat_ws(chr(10) || chr(10), what_happened, follow_up_text, CASE WHEN follow_up = 'retry' THEN 'Try again: ' || url END, 'Contact us: mailto:{SUPPORT}') END, '— {APP}') AS body
 FROM (SELECT l.*, CASE status WHEN 'succeeded' THEN 'Your report is ready: ' ELSE 'We could not finish your report: ' END || report_name AS subject, '{SITE}/orgs/' || organization_id || '/reports/' || report_id AS url FROM {_LOADED}) m LEFT JOIN {_SAID} USING (failure_reason)""",
    "n_invites": f"""SELECT i.id, 'organization-invite' AS kind, i.email AS recipient, 'Join ' || o.name || ' on {APP}' AS subject,
 concat_ws(chr(10) || chr(10), 'Join ' || o.name || ' on {APP}', coalesce(u.display_name, 'An admin') || ' invited you to join ' || o.name || '. Sign in with this email address to accept.', 'Accept the invitation: {SITE}/sign-in?email=' || replace(i.email, '@', '%40'),
 'Organization: ' || o.name || chr(10) || 'Role: ' || CASE i.role WHEN 'admin' THEN 'Admin' ELSE 'Member' END || chr(10) || 'Expires: ' || strftime(expires_at, '%B %-d, %Y'), '— {APP}') AS body
 FROM invites i JOIN orgs o ON o.id = organization_id LEFT JOIN users u ON u.id = i.id AND i.id % 3 <> 1""",
    "n_notices": f"""SELECT o.id, CASE WHEN o.id % 2 = 0 THEN 'ops-organization-created' ELSE 'ops-organization-deleted' END AS kind, 'ops@example.org' AS recipient, CASE WHEN o.id % 2 = 0 THEN 'New organization: ' ELSE 'Organization deleted: ' END || name AS subject,
 concat_ws(chr(10) || chr(10), CASE WHEN o.id % 2 = 0 THEN 'New organization: ' ELSE 'Organization deleted: ' END || name, CASE WHEN o.id % 2 = 1 THEN 'Its reports and input files were deleted with it. No user accounts were.' END, 'Organization: ' || name || chr(10) || CASE WHEN o.id % 2 = 0 THEN 'Created by: ' ELSE 'Deleted by: ' END || email, '— {APP}') AS body
 FROM orgs o JOIN users u ON u.id = created_by_user_id
 UNION ALL SELECT id, 'ops-user-deleted', 'ops@example.org', 'User deleted: ' || email, concat_ws(chr(10) || chr(10), 'User deleted: ' || email, 'Their reports remain with their organizations, showing a deleted user as the submitter.', 'Account: ' || email, '— {APP}') FROM users""",
    "n_stamp": f"SELECT id, CAST(coalesce(notification_email_sent_at, {TS}) AS VARCHAR) AS sent_at FROM attempts WHERE finished_at IS NOT NULL",
    "n_window": "SELECT id, CAST(300 * (pow(2, notification_attempts - 1) - 1) AS BIGINT) AS seconds FROM attempts WHERE notification_attempts > 0",
    "i_checks": " UNION ALL ".join([_checks("attempts", audit.ATTEMPT_CHECKS), *[_checks(t, c).replace("octet_length(checksum)", "CASE WHEN cut THEN 31 ELSE 32 END") for t, c in audit.OTHER_CHECKS.items()]]),
    "i_vocabulary": " UNION ALL ".join(f"SELECT '{c}_vocabulary' AS rule, '{t}' AS \"table\", {_KEY(t)} AS key FROM kept_{t} WHERE {c} NOT IN ({', '.join(map(_q, v))})" for t, columns in VOCABULARIES.items() for c, v in columns.items()),
    "i_unique": " UNION ALL ".join(f"SELECT '{r}' AS rule, '{t}' AS \"table\", concat_ws('|', {', '.join(cols)}) AS key, count(*) AS n FROM kept_{t} WHERE {w or 'true'} AND {' AND '.join(f'{c} IS NOT NULL' for c in cols)} GROUP BY 3 HAVING count(*) > 1" for t, rules in audit.UNIQUE.items() for r, (cols, w) in rules.items()),
    "i_foreign": " UNION ALL ".join(f"SELECT '{t}.{c}' AS rule, '{t}' AS \"table\", {_KEY(t)} AS key FROM kept_{t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM kept_{p})" for t, of in audit.EDGES.items() for c, p in of.items()),
    "i_retry": """SELECT id, report_id, fault FROM (SELECT id, report_id, CASE WHEN attempt_number > 5 THEN 'too-many' WHEN n IS NULL AND attempt_number <> 1 THEN 'first-is-not-one' WHEN attempt_number <> n + 1 THEN 'gap' WHEN s <> 'failed' THEN 'after-no-failure' END AS fault
 FROM (SELECT id, report_id, attempt_number, lag(attempt_number) OVER w AS n, lag(status) OVER w AS s FROM attempts WINDOW w AS (PARTITION BY report_id ORDER BY attempt_number, id)) x) y WHERE fault IS NOT NULL""",
    "i_frozen": "SELECT id, CASE WHEN id % 211 = 0 THEN 'deleted' ELSE 'changed' END AS fault FROM attempts WHERE status IN ('succeeded', 'failed', 'canceled') AND (id % 211 = 0 OR id % 101 = 0)",
    "i_append": "SELECT event_id, CASE WHEN event_id % 503 = 2 THEN 'deleted' ELSE 'changed' END AS fault FROM events WHERE event_id % 503 = 2 OR event_id % 307 = 1",
    "i_admins": "SELECT o.id, CASE WHEN count(m.user_id) = 0 THEN 'no-member' ELSE 'no-admin' END AS fault FROM orgs o LEFT JOIN members m ON m.organization_id = o.id GROUP BY o.id HAVING count(*) FILTER (m.role = 'admin') = 0",
    "i_counters": "SELECT u.id, organizations_created_count, count(*) AS observed FROM users u JOIN orgs o ON o.created_by_user_id = u.id GROUP BY 1, 2 HAVING organizations_created_count < count(*)",
    "i_no_input": "SELECT id FROM reports WHERE id NOT IN (SELECT report_id FROM input_files)",
    "i_deleted_retry": "SELECT a.id, report_id FROM attempts a JOIN reports r ON r.id = report_id WHERE a.created_at > r.deleted_at",
    "i_objects": "SELECT 'dangling' AS fault, storage_key AS key FROM input_files WHERE storage_key NOT IN (SELECT key FROM objects) UNION ALL SELECT 'orphan', key FROM objects WHERE replace(key, '-original.csv', '.csv') NOT IN (SELECT storage_key FROM input_files)",
    "i_result_keys": """SELECT id, storage_key, faults FROM (SELECT f.id, storage_key, CASE WHEN NOT regexp_full_match(storage_key, 'org/[^/]*/report/[^/]*/analysis-attempt/[^/]*/result/[^/]*') THEN 'shape' ELSE concat_ws(',',
 CASE WHEN NOT starts_with(storage_key, 'org/' || organization_id || '/') THEN 'organization' END, CASE WHEN NOT contains(storage_key, '/report/' || report_id || '/') THEN 'report' END,
 CASE WHEN NOT contains(storage_key, '/analysis-attempt/' || analysis_attempt_id || '/') THEN 'attempt' END, CASE WHEN NOT regexp_matches(storage_key, '/result/' || f.id || '([.]|$)') THEN 'id' END,
 CASE WHEN regexp_replace(storage_key, '^.*/[^./]*', '') <> CASE kind WHEN 'chart' THEN '.png' ELSE '.' || kind END THEN 'extension' END) END AS faults
 FROM stored_results f JOIN attempts a ON a.id = f.analysis_attempt_id JOIN reports r ON r.id = a.report_id) x WHERE faults <> ''""",
    "i_keys": "SELECT f.id, storage_key, expected FROM (SELECT f.id, f.storage_key, 'org/' || organization_id || '/report/' || report_id || '/input/' || f.id || '.csv' AS expected FROM input_files f JOIN reports r ON r.id = f.report_id) f WHERE storage_key <> expected",
}
ORACLE_SQL = {k: with_views(v) for k, v in _SQL.items()}
