"""Queries of access, product reading and metrics, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators import access, lifecycle, metrics
from larder.plans.intake import CTES, _accepted
from larder.plans.upkeep import TS, _q, s
from larder.sources.store import settle
from larder.sources.views import NOW, view, with_views


def _granted(spark: SparkSession, d: str) -> DataFrame:
    return access.access(view(spark, d, "users"), view(spark, d, "orgs"), view(spark, d, "members"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return access.live_invites(view(spark, d, "invites"), NOW)


def _outsiders(spark: SparkSession, d: str) -> DataFrame:
    """Users of no organization."""
    return view(spark, d, "users").join(view(spark, d, "members").select(F.col("user_id").alias("id")), "id", "left_anti")


def q_closure(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: view(spark, d, n) for n in ("reports", "attempts", "members", "invites", "rejections", "input_files", "result_files")}
    """What goes with the organizations that have no admin left."""
    orphaned = view(spark, d, "orgs").join(tables["members"].where("role = 'admin'").select(F.col("organization_id").alias("id")), "id", "left_anti")
    found = access.closure(orphaned, tables)
    return reduce(DataFrame.unionByName, [v.groupBy(F.lit(k).alias("table")).agg(F.count("*").alias("n"), F.sum("id").alias("ids")) for k, v in found.items()])


def q_forget(spark: SparkSession, d: str) -> DataFrame:
    """Reports after the users who belong to no organization are deleted."""
    gone = _outsiders(spark, d)
    return access.forget_user(gone, view(spark, d, "reports").select("id", "created_by_user_id"), "created_by_user_id")


def q_access(spark: SparkSession, d: str) -> DataFrame:
    return _granted(spark, d)


def q_check(spark: SparkSession, d: str) -> DataFrame:
    pairs = view(spark, d, "reports").select(F.col("created_by_user_id").alias("user_id"), "organization_id", (F.col("id") % 2 == 0).alias("needs_admin")).distinct()
    return access.check_access(pairs, view(spark, d, "users"), view(spark, d, "orgs"), view(spark, d, "members")).select("user_id", "organization_id", "needs_admin", "status")


def q_destination(spark: SparkSession, d: str) -> DataFrame:
    users = view(spark, d, "users").withColumn("email", F.when(F.col("id") % 3 == 0, F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.org"))).otherwise(F.col("email")))
    return access.destinations(users, view(spark, d, "orgs"), view(spark, d, "members"), _live(spark, d))


def q_live_invites(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select("id", F.lower("email").alias("email"))


def q_invite_state(spark: SparkSession, d: str) -> DataFrame:
    return access.resolve_invites(view(spark, d, "invites"), NOW)


def q_reports(spark: SparkSession, d: str) -> DataFrame:
    return access.report_list(view(spark, d, "reports"), view(spark, d, "attempts")).select("id", "organization_id", "place", "attempt_id", "status")


def q_detail(spark: SparkSession, d: str) -> DataFrame:
    got = access.report_detail(view(spark, d, "reports"), view(spark, d, "input_files"), view(spark, d, "attempts"), view(spark, d, "result_files"))
    return got.select("id", "original_filename", "attempt_id", "status", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["id"], f["kind"], f["chart_key"])), ",").alias("files"))


def q_timeline(spark: SparkSession, d: str) -> DataFrame:
    return access.timeline(view(spark, d, "attempts")).select("attempt_id", "event", s("at"))


def q_input_links(spark: SparkSession, d: str) -> DataFrame:
    return access.input_links(view(spark, d, "input_files"), view(spark, d, "reports"))


def q_result_links(spark: SparkSession, d: str) -> DataFrame:
    return access.result_links(view(spark, d, "result_files"), view(spark, d, "attempts"), view(spark, d, "reports"))


def q_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """The reports of users who belong to no organization are asked to go."""
    asked = view(spark, d, "reports").join(_outsiders(spark, d).select(F.col("id").alias("created_by_user_id")), "created_by_user_id", "left_semi").select("id")
    r, a = access.soft_delete(view(spark, d, "reports"), view(spark, d, "attempts"), asked, NOW)
    return r.select(F.lit("report").alias("what"), "id").unionByName(a.select(F.lit("attempt").alias("what"), "id"))


def q_sole_admins(spark: SparkSession, d: str) -> DataFrame:
    return access.sole_admins(view(spark, d, "members"))


def q_roster(spark: SparkSession, d: str) -> DataFrame:
    return access.roster(view(spark, d, "members"), view(spark, d, "users"), _live(spark, d))


_HOUR, _WEEK = 3600, 7 * 86400
_THEN = "2009-06-15 00:00:00"


def q_allowance(spark: SparkSession, d: str) -> DataFrame:
    """What each member may still upload a while after the middle upload of the log."""
    return access.upload_allowance(view(spark, d, "members"), view(spark, d, "upload_log"), "created_at", _THEN)


def q_rate_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Uploads over a limit of their organization or user, and invites over their organization's."""
    both = {"hour": (_HOUR, fixed.UPLOADS_PER_HOUR), "week": (_WEEK, fixed.UPLOADS_PER_WEEK)}
    found = [access.rate_breaks(view(spark, d, "upload_log"), by, "created_at", both).withColumn("what", F.lit(f"uploads by {by}")) for by in ("organization_id", "user_id")]
    found.append(access.rate_breaks(view(spark, d, "invite_log"), "organization_id", "created_at", {"hour": (_HOUR, fixed.INVITES_PER_HOUR)}).withColumn("what", F.lit("invites by organization_id")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def q_org_allowance(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "users").select("id", (F.lit(fixed.MAX_ORGS_CREATED) - F.col("organizations_created_count")).alias("left"))


def q_permissions(spark: SparkSession, d: str) -> DataFrame:
    """What everyone may do where, superadmins too."""
    return access.permissions(_granted(spark, d))


def q_trail(spark: SparkSession, d: str) -> DataFrame:
    return access.trail(view(spark, d, "events"), "user_id", "ts", "event_id", 10).select("user_id", "event_id", "place")


def q_screen(spark: SparkSession, d: str) -> DataFrame:
    said = lifecycle.explanations(spark).select("failure_reason", "follow_up")
    return access.screen_state(access.latest_attempts(view(spark, d, "attempts")), F.broadcast(said), NOW, 3600)


def q_retryable(spark: SparkSession, d: str) -> DataFrame:
    return access.retryable(view(spark, d, "reports"), view(spark, d, "attempts"))


def m_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cumulative(view(spark, d, "reports"), "created_at").select(s("period"), "n", "total")


def m_durations(spark: SparkSession, d: str) -> DataFrame:
    return metrics.durations(view(spark, d, "attempts"), [0.5, 0.9]).withColumn("day", F.col("day").cast("string"))


def m_costs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.costs(view(spark, d, "attempts"), view(spark, d, "reports")).withColumn("cost", F.col("cost").cast("string"))


def m_model_costs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.model_costs(view(spark, d, "attempts")).withColumn("cost", F.col("cost").cast("string"))


def m_rejection_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rejection_rates(view(spark, d, "rejections"), view(spark, d, "reports")).withColumn("rate", F.round("rate", 6))


def m_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failure_rates(view(spark, d, "attempts"), 0.7)


def m_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures_by_reason(view(spark, d, "attempts"))


def m_waiting(spark: SparkSession, d: str) -> DataFrame:
    """M5: pending attempts that have waited for more than ten minutes."""
    a = view(spark, d, "attempts").where("status = 'pending'").withColumn("seconds", F.unix_timestamp(lifecycle.moment(NOW)) - F.unix_timestamp("created_at"))
    return a.where("seconds > 600").select("id", "seconds")


def m_rejections(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rejection_cube(view(spark, d, "rejections"))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").where("p_name NOT LIKE '%ring'").groupBy(F.col("p_name").alias("product")).agg(F.min("p_type").alias("category"))
    return p.withColumn("approved", F.length("product") % 2 == 0)


def m_weight(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weight_by_month(_accepted(spark, d)).withColumn("weight", F.round("weight", 6))


def m_per_person(spark: SparkSession, d: str) -> DataFrame:
    by = settle(metrics.weight_by_month(_accepted(spark, d)), "weights")
    counts = by.groupBy("upload").agg(F.map_from_entries(F.collect_list(F.struct("month", (F.col("upload") % 50).alias("n")))).alias("counts"))
    return metrics.per_person(by, counts).select("upload", "month", F.round("per_person", 6).alias("per_person"))


def m_top(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_products(_accepted(spark, d), 2).withColumn("weight", F.round("weight", 6))


def m_category(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_category(_accepted(spark, d), _categories(spark, d)).withColumn("weight", F.round("weight", 4))


def m_review(spark: SparkSession, d: str) -> DataFrame:
    return metrics.to_review(_accepted(spark, d), _categories(spark, d))


def m_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_counters(_accepted(spark, d), _categories(spark, d))


def m_units(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.when(F.col("l_orderkey") % 2 == 0, "lb").otherwise("kg").alias("unit"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(metrics.to_kg(F.col("l_quantity"), F.col("unit"))), 5).alias("kg"))


QUERIES = {
    f.__name__: f
    for f in (
        q_closure, q_forget, q_access, q_check, q_destination, q_live_invites, q_invite_state, q_reports, q_detail, q_timeline, q_input_links, q_result_links, q_soft_delete, q_sole_admins,
        q_roster, q_allowance, q_rate_breaks, q_org_allowance, q_permissions, q_trail, q_screen, q_retryable, m_cumulative, m_durations, m_costs, m_model_costs, m_rejection_rate, m_failure_rate, m_failure_reasons, m_waiting,
        m_rejections, m_weight, m_per_person, m_top, m_category, m_review, m_counters, m_units,
    )
}

_ORG = "(SELECT id FROM orgs WHERE id NOT IN (SELECT organization_id FROM members WHERE role = 'admin'))"
_OUT = "(SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM members))"
_REP = f"(SELECT id FROM reports WHERE organization_id IN {_ORG})"
_ATT = f"(SELECT id FROM attempts WHERE report_id IN {_REP})"
_C = {
    **CTES,
    "granted": "SELECT user_id, organization_id, role FROM members WHERE user_id NOT IN (SELECT id FROM users WHERE is_superadmin) UNION ALL SELECT u.id, o.id, 'admin' FROM users u, (SELECT * FROM orgs) o WHERE is_superadmin",
    "live": f"SELECT * FROM invites WHERE status = 'pending' AND expires_at > {TS}",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY attempt_number DESC, id DESC) AS rn FROM attempts) x WHERE rn = 1",
    "cats": "SELECT p_name AS product, min(p_type) AS category, length(p_name) % 2 = 0 AS approved FROM part WHERE p_name NOT LIKE '%ring' GROUP BY p_name",
}
_PERM = ", ".join(f"({_q(r)}, {_q(p)})" for p, roles in fixed.PERMISSIONS.items() for r in roles)
_FOLLOW = ", ".join(f"({_q(r)}, {_q(v[1])})" for r, v in fixed.FAILURE_EXPLANATIONS.items())
_LEFT = f"greatest(least(5 - count(*) FILTER (created_at > TIMESTAMP '{_THEN}' - INTERVAL 1 HOUR), 20 - count(*) FILTER (created_at > TIMESTAMP '{_THEN}' - INTERVAL 7 DAY)), 0) AS n FROM upload_log WHERE created_at <= TIMESTAMP '{_THEN}'"
_SQL = {
    "q_closure": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS n, CAST(sum({k}) AS BIGINT) AS ids FROM {t} WHERE {w} HAVING count(*) > 0"
        for t, k, w in [
            ("members", "user_id", f"organization_id IN {_ORG}"), ("invites", "id", f"organization_id IN {_ORG}"), ("rejections", "id", f"organization_id IN {_ORG}"), ("reports", "id", f"organization_id IN {_ORG}"),
            ("input_files", "id", f"report_id IN {_REP}"), ("attempts", "id", f"report_id IN {_REP}"), ("result_files", "id", f"analysis_attempt_id IN {_ATT}"),
        ]
    ),
    "q_forget": f"SELECT id, CASE WHEN created_by_user_id IN {_OUT} THEN NULL ELSE created_by_user_id END AS created_by_user_id FROM reports",
    "q_access": "SELECT * FROM granted",
    "q_check": "SELECT p.*, CASE WHEN role IS NULL THEN 404 WHEN needs_admin AND role <> 'admin' THEN 403 ELSE 200 END AS status FROM (SELECT DISTINCT created_by_user_id AS user_id, organization_id, id % 2 = 0 AS needs_admin FROM reports) p LEFT JOIN granted USING (user_id, organization_id)",
    "q_destination": "SELECT u.id, CASE WHEN em IN (SELECT lower(email) FROM live) THEN 'invite' WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' ELSE 'pick' END AS destination FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'user' || id || '@example.org' ELSE email END AS em FROM users) u LEFT JOIN (SELECT user_id, count(*) AS n FROM granted GROUP BY 1) g ON g.user_id = u.id",
    "q_live_invites": "SELECT id, lower(email) AS email FROM live",
    "q_invite_state": f"SELECT id, CASE WHEN status = 'pending' AND i > 1 THEN 'superseded' WHEN status = 'pending' AND expires_at <= {TS} THEN 'expired' ELSE status END AS state FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, lower(email), status = 'pending' ORDER BY created_at DESC, id DESC) AS i FROM invites) x",
    "q_reports": "SELECT r.id, organization_id, place, l.id AS attempt_id, l.status FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, id DESC) AS place FROM reports WHERE deleted_at IS NULL) r LEFT JOIN latest l ON l.report_id = r.id",
    "q_detail": "SELECT r.id, original_filename, l.id AS attempt_id, l.status, files FROM reports r LEFT JOIN input_files i ON i.report_id = r.id LEFT JOIN latest l ON l.report_id = r.id LEFT JOIN (SELECT analysis_attempt_id, string_agg(concat_ws(':', id, kind, chart_key), ',' ORDER BY id) AS files FROM result_files GROUP BY 1) f ON f.analysis_attempt_id = l.id WHERE deleted_at IS NULL",
    "q_timeline": " UNION ALL ".join(f"SELECT id AS attempt_id, '{e}' AS event, CAST({c} AS VARCHAR) AS \"at\" FROM attempts WHERE {c} IS NOT NULL" for e, c in {"created": "created_at", "claimed": "claimed_at", "renewed": "lease_renewed_at", "cancel-requested": "cancel_requested_at", "finished": "finished_at", "notified": "notification_email_sent_at"}.items()),
    "q_input_links": "SELECT f.id, storage_key, original_filename AS filename FROM input_files f JOIN reports r ON r.id = report_id WHERE deleted_at IS NULL",
    "q_result_links": "SELECT f.id, f.storage_key, CASE WHEN kind <> 'chart' THEN r.name || '.' || kind END AS filename FROM result_files f JOIN attempts a ON a.id = analysis_attempt_id JOIN reports r ON r.id = a.report_id WHERE deleted_at IS NULL",
    "q_soft_delete": f"SELECT 'report' AS what, id FROM reports WHERE deleted_at IS NULL AND created_by_user_id IN {_OUT} UNION ALL SELECT 'attempt', a.id FROM attempts a JOIN reports r ON r.id = report_id WHERE deleted_at IS NULL AND r.created_by_user_id IN {_OUT} AND status IN ('pending', 'processing') AND cancel_requested_at IS NULL",
    "q_sole_admins": "SELECT min(user_id) AS user_id, organization_id FROM members WHERE role = 'admin' GROUP BY organization_id HAVING count(*) = 1",
    "q_roster": "SELECT organization_id, display_name AS who, role, 'member' AS kind FROM members JOIN users ON id = user_id WHERE NOT is_superadmin UNION ALL SELECT organization_id, email, role, 'invited' FROM live",
    "q_allowance": f"""SELECT user_id, organization_id, least(coalesce(o.n, 5), coalesce(u.n, 5)) AS "left" FROM members
 LEFT JOIN (SELECT organization_id, {_LEFT} GROUP BY 1) o USING (organization_id) LEFT JOIN (SELECT user_id, {_LEFT} GROUP BY 1) u USING (user_id)""",
    "q_rate_breaks": " UNION ALL ".join(
        f"SELECT id, CAST({by} AS BIGINT) AS key, '{name}' AS \"limit\", n, '{what} by {by}' AS what FROM (SELECT id, {by}, count(*) OVER (PARTITION BY {by} ORDER BY epoch(created_at) RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW) AS n FROM {log}) x WHERE n > {most}"
        for what, log, by, name, seconds, most in (("uploads", "upload_log", "organization_id", "hour", 3600, 5), ("uploads", "upload_log", "organization_id", "week", 604800, 20), ("uploads", "upload_log", "user_id", "hour", 3600, 5), ("uploads", "upload_log", "user_id", "week", 604800, 20), ("invites", "invite_log", "organization_id", "hour", 3600, 5))
    ),
    "q_org_allowance": "SELECT id, 5 - organizations_created_count AS \"left\" FROM users",
    "q_permissions": f"SELECT user_id, organization_id, permission FROM granted JOIN (VALUES {_PERM}) v(role, permission) USING (role)",
    "q_trail": "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) x WHERE place <= 10",
    "q_screen": f"SELECT report_id, CASE WHEN status = 'pending' THEN 'queued' WHEN status = 'failed' THEN 'failed-' || coalesce(follow_up, 'contact') ELSE status END AS state, coalesce(epoch({TS}) - epoch(CASE status WHEN 'pending' THEN created_at WHEN 'processing' THEN claimed_at END) > 3600, false) AS overrun, status IN ('succeeded', 'failed', 'canceled') AS may_retry FROM latest LEFT JOIN (VALUES {_FOLLOW}) v(failure_reason, follow_up) USING (failure_reason)",
    "q_retryable": "SELECT report_id, attempt_number + 1 AS next_number FROM latest WHERE status = 'failed' AND attempt_number < 5 AND report_id IN (SELECT id FROM reports WHERE deleted_at IS NULL) AND report_id NOT IN (SELECT report_id FROM attempts WHERE status IN ('pending', 'processing'))",
    "m_cumulative": "SELECT CAST(CAST(p AS TIMESTAMP) AS VARCHAR) AS period, n, CAST(sum(n) OVER (ORDER BY p) AS BIGINT) AS total FROM (SELECT date_trunc('month', created_at) AS p, count(*) AS n FROM reports GROUP BY 1) x",
    "m_durations": "SELECT CAST(CAST(date_trunc('day', created_at) AS TIMESTAMP) AS VARCHAR) AS day, " + ", ".join(f"quantile_cont({e}, {p}) AS {n}_p{int(p * 100)}" for n, e in {"wait": "epoch(claimed_at) - epoch(created_at)", "run": "epoch(finished_at) - epoch(claimed_at)", "total": "epoch(finished_at) - epoch(created_at)"}.items() for p in (0.5, 0.9)) + " FROM attempts GROUP BY date_trunc('day', created_at)",
    "m_model_costs": "SELECT ai_model, strftime(finished_at, '%Y-%m') AS month, CAST(sum(ai_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(ai_output_tokens) AS BIGINT) AS output_tokens, CAST(sum(ai_cost_usd) AS VARCHAR) AS cost, count(*) AS n FROM attempts WHERE ai_model IS NOT NULL GROUP BY 1, 2",
    "m_rejection_rate": "SELECT organization_id, count(*) AS uploads, CAST(sum(r) AS BIGINT) AS rejected, round(sum(r) / count(*), 6) AS rate FROM (SELECT organization_id, 1 AS r FROM rejections UNION ALL SELECT organization_id, 0 FROM reports) x GROUP BY 1",
    "m_costs": "SELECT organization_id, strftime(finished_at, '%Y-%m') AS month, CAST(sum(ai_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(ai_output_tokens) AS BIGINT) AS output_tokens, CAST(sum(ai_cost_usd) AS VARCHAR) AS cost, count(*) AS n FROM attempts a JOIN reports r ON r.id = report_id WHERE ai_model IS NOT NULL GROUP BY ROLLUP (organization_id, strftime(finished_at, '%Y-%m'))",
    "m_failure_rate": "SELECT strftime(finished_at, '%Y-%m') AS month, count(*) AS finished, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed') / count(*) AS rate, count(*) FILTER (status = 'failed') / count(*) > 0.7 AS alert FROM attempts WHERE finished_at IS NOT NULL GROUP BY 1",
    "m_failure_reasons": "SELECT failure_reason, count(*) AS n FROM attempts WHERE status = 'failed' GROUP BY 1",
    "m_waiting": f"SELECT id, CAST(epoch({TS}) - epoch(created_at) AS BIGINT) AS seconds FROM attempts WHERE status = 'pending' AND epoch({TS}) - epoch(created_at) > 600",
    "m_rejections": "SELECT organization_id, rejection_reason, count(*) AS n FROM rejections GROUP BY CUBE (organization_id, rejection_reason)",
    "m_weight": "SELECT upload, iso[1:7] AS month, round(sum(weight), 6) AS weight FROM accepted GROUP BY 1, 2",
    "m_per_person": "SELECT upload, iso[1:7] AS month, CASE WHEN upload % 50 > 0 THEN round(sum(weight) / (upload % 50), 6) END AS per_person FROM accepted GROUP BY 1, 2",
    "m_top": "SELECT * FROM (SELECT upload, product, round(weight, 6) AS weight, row_number() OVER (PARTITION BY upload ORDER BY weight DESC, product) AS place FROM (SELECT upload, product, sum(weight) AS weight FROM accepted GROUP BY 1, 2) x) y WHERE place <= 2",
    "m_category": "SELECT iso[1:7] AS month, coalesce(category, 'uncategorized') AS category, round(sum(weight), 4) AS weight, count(*) AS n FROM accepted LEFT JOIN cats USING (product) GROUP BY 1, 2",
    "m_review": "SELECT product, count(*) AS n FROM accepted WHERE product NOT IN (SELECT product FROM cats WHERE approved) GROUP BY 1",
    "m_counters": "SELECT upload, count(*) AS rows_in, count(category) AS rows_categorized, count(DISTINCT product) FILTER (category IS NULL) AS products_uncategorized FROM accepted LEFT JOIN cats USING (product) GROUP BY 1",
    "m_units": "SELECT l_orderkey, round(sum(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity * 0.45359237 ELSE l_quantity END), 5) AS kg FROM lineitem GROUP BY 1",
}
ORACLE_SQL = {k: with_views(v, _C) for k, v in _SQL.items()}
