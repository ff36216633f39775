"""Reference-shaped inputs derived from the star tables.

Each view is one SQL text that Spark and any other SQL engine read alike;
operators take the resulting DataFrames, oracles put the same text in a WITH.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "pages", "conversations",
]
NOW = "2011-12-31 12:00:00"
"""The moment of every batch query; the derived uploads end before it."""

VIEWS = {
    "cells": """
SELECT upload, line,
  CASE hp WHEN 3 THEN '' WHEN 5 THEN 'N/A' WHEN 7 THEN concat('=', p_name) WHEN 11 THEN concat('  ', p_name, ' ')
    WHEN 13 THEN concat(p_name, '​') WHEN 17 THEN repeat('x', 201) WHEN 19 THEN concat(p_name, ', "raw"')
    WHEN 23 THEN concat('-', p_name) ELSE p_name END AS product,
  CASE hd WHEN 1 THEN '45000' WHEN 3 THEN '2005-02-30' WHEN 5 THEN '1999-12-31' WHEN 7 THEN '2030-01-01' WHEN 9 THEN 'never'
    WHEN 11 THEN 'Foo 2005' WHEN 13 THEN '' WHEN 15 THEN '31/06/2005' ELSE
    CASE style WHEN 0 THEN concat(y, '-', m, '-', d) WHEN 1 THEN concat(y, m, d) WHEN 2 THEN concat(d, '/', m, '/', y)
      WHEN 3 THEN concat(m, '/', d, '/', y) WHEN 4 THEN concat(CAST(CAST(d AS INT) AS STRING), ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(m AS INT) * 3 - 2, 3), ', ', y)
      WHEN 5 THEN concat(y, '.', m, '.', d, ' 10:30') ELSE
      CASE line % 2 WHEN 0 THEN concat(d, '-', m, '-', y) ELSE concat(m, '-', d, '-', y) END END END AS date,
  CASE hw WHEN 2 THEN '5 oz' WHEN 4 THEN '$12' WHEN 6 THEN '-5' WHEN 8 THEN '(50)' WHEN 10 THEN '1e3' WHEN 12 THEN ''
    WHEN 14 THEN '1.234,56' WHEN 16 THEN 'abc' WHEN 18 THEN '12%' WHEN 20 THEN '1234567890123456' WHEN 22 THEN concat('1,', lpad(q, 3, '0'), '.50')
    WHEN 24 THEN concat(' ', q, '.25 ') ELSE q END AS weight
FROM (
  SELECT l_orderkey AS upload,
    1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) AS line,
    p_name,
    (31 * l_orderkey + 7 * l_linenumber + l_partkey) % 211 AS hp,
    (11 * l_orderkey + 3 * l_linenumber + l_partkey) % 223 AS hd,
    (7 * l_orderkey + 13 * l_linenumber + l_suppkey) % 227 AS hw,
    CASE WHEN l_orderkey % 40 = 6 THEN 6 ELSE l_orderkey % 6 END AS style,
    CAST(year(l_shipdate) + 10 AS STRING) AS y,
    lpad(CAST(month(l_shipdate) AS STRING), 2, '0') AS m,
    lpad(CAST(least(day(l_shipdate), 28) AS STRING), 2, '0') AS d,
    CAST(CAST(l_quantity AS INT) AS STRING) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey) x""",
    "forms": """
SELECT upload, CASE WHEN upload % 43 = 1 THEN '  ' ELSE concat('Upload ', CAST(upload AS STRING)) END AS name, CAST(NULL AS STRING) AS site_name,
  CASE WHEN upload % 47 = 3 THEN 'cats' ELSE 'people' END AS counts_basis, 'kg' AS unit_system, concat('{', string_agg(month_count, ', '), '}') AS counts
FROM (
  SELECT upload, concat('"', month, '": ', CASE WHEN upload % 53 = 4 THEN 'true' ELSE CAST(count(*) AS STRING) END) AS month_count
  FROM (SELECT l_orderkey AS upload, concat(CAST(year(l_shipdate) + 10 AS STRING), '-', lpad(CAST(month(l_shipdate) AS STRING), 2, '0')) AS month FROM lineitem) l
  GROUP BY upload, month) c
GROUP BY upload""",
    "orgs": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey * 7 % 40 AS BIGINT) AS created_by_user_id,
  CAST(CAST('2001-01-01' AS DATE) + n_nationkey AS TIMESTAMP) AS created_at FROM nation""",
    "users": """
SELECT c_custkey AS id, c_name AS display_name, concat(lower(replace(c_name, '#', '.')), '@example.org') AS email,
  c_custkey % 97 = 5 AS is_superadmin, CAST(CASE WHEN c_custkey < 40 THEN c_custkey % 4 ELSE 0 END AS INT) AS organizations_created_count
FROM customer""",
    "members": """
SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS organization_id,
  CASE WHEN c_custkey % 11 = 0 AND c_nationkey <> 7 AND (c_nationkey % 5 <> 3 OR c_custkey < 150) THEN 'admin' ELSE 'member' END AS role FROM customer WHERE c_custkey % 5 <> 4
UNION ALL
SELECT c_custkey, CAST((c_nationkey + 3) % 25 AS BIGINT), CASE WHEN c_custkey % 13 = 0 AND (c_nationkey + 3) % 25 <> 7 AND (c_nationkey + 3) % 5 <> 3 THEN 'admin' ELSE 'member' END
FROM customer WHERE c_custkey % 7 = 2""",
    "invites": """
SELECT c_custkey AS id, CAST((c_nationkey + 1) % 25 AS BIGINT) AS organization_id,
  CASE WHEN c_custkey % 31 = 0 THEN upper(email) ELSE email END AS email, CASE WHEN c_custkey % 6 = 0 THEN 'admin' ELSE 'member' END AS role,
  CASE c_custkey % 7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'revoked' ELSE 'pending' END AS status,
  CAST(CAST('2011-12-01' AS DATE) + CAST(c_custkey % 30 AS INT) AS TIMESTAMP) AS created_at,
  CAST(CAST('2011-12-01' AS DATE) + CAST(c_custkey % 30 + 14 AS INT) AS TIMESTAMP) AS expires_at
FROM (SELECT c_custkey, c_nationkey, concat('user', CAST(c_custkey % 300 AS STRING), '@example.org') AS email FROM customer) c""",
    "reports": """
SELECT id, org AS organization_id, who AS created_by_user_id, concat('Report ', CAST(id AS STRING)) AS name,
  CASE WHEN id % 2 = 0 THEN 'people' ELSE 'meals' END AS counts_basis, CASE WHEN id % 3 = 0 THEN 'lb' ELSE 'kg' END AS unit_system,
  created_at, CASE WHEN id % 17 = 3 THEN created_at + INTERVAL 9 DAY WHEN id % 401 = 7 THEN created_at - INTERVAL 1 DAY END AS deleted_at
FROM (
  SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS id, min(CAST(c_nationkey AS BIGINT)) AS org, min(o_custkey) AS who, min(o_orderdate) + INTERVAL 3650 DAY AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CAST(floor(o_orderkey / 3) AS BIGINT)) r""",
    "attempts": """
SELECT id, report_id, attempt_number, status, requested_by_user_id, created_at, worker_id, claimed_at, lease_renewed_at,
  CASE WHEN status IN ('succeeded', 'failed', 'canceled') AND id % 389 <> 9 THEN lease_renewed_at + INTERVAL 2 MINUTE END AS finished_at,
  CASE WHEN status = 'canceled' OR id % 29 = 11 THEN created_at + INTERVAL 1 MINUTE END AS cancel_requested_at,
  CASE WHEN status = 'failed' AND id % 331 <> 5 THEN
    CASE id % 10 WHEN 0 THEN 'child_crashed' WHEN 1 THEN 'hung' WHEN 2 THEN 'hard_timeout' WHEN 3 THEN 'infrastructure' WHEN 4 THEN 'contract_violation'
      WHEN 5 THEN 'upstream_api' WHEN 6 THEN 'abandoned' WHEN 7 THEN 'unknown' WHEN 8 THEN 'shut_down' ELSE 'unusable_data' END END AS failure_reason,
  CASE WHEN status = 'succeeded' THEN concat('model-', CAST(id % 3 AS STRING)) END AS ai_model,
  CASE WHEN status = 'succeeded' THEN CAST(id % 5000 AS INT) END AS ai_input_tokens,
  CASE WHEN status = 'succeeded' THEN CAST(id % 700 AS INT) END AS ai_output_tokens,
  CASE WHEN status = 'succeeded' THEN CAST((id % 900) / 100 AS DECIMAL(10, 4)) END AS ai_cost_usd,
  CASE WHEN status IN ('succeeded', 'failed') AND id % 7 < 3 THEN lease_renewed_at + INTERVAL 3 MINUTE END AS notification_claimed_at,
  CASE WHEN status IN ('succeeded', 'failed') AND id % 7 < 3 THEN CAST(1 + id % 5 AS INT) ELSE 0 END AS notification_attempts,
  CASE WHEN status IN ('succeeded', 'failed') AND id % 7 < 3 THEN concat('w', CAST(id % 4 AS STRING)) END AS notification_claimed_by_worker_id,
  CASE WHEN status IN ('succeeded', 'failed') AND id % 7 = 0 THEN lease_renewed_at + INTERVAL 4 MINUTE END AS notification_email_sent_at
FROM (
  SELECT o_orderkey AS id, CAST(floor(o_orderkey / 3) AS BIGINT) AS report_id, CAST(o_orderkey % 3 + 1 + CASE WHEN o_orderkey % 503 = 2 THEN 4 ELSE 0 END AS INT) AS attempt_number,
    status, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS requested_by_user_id, created_at,
    CASE WHEN status <> 'pending' OR o_orderkey % 613 = 1 THEN concat('w', CAST(o_orderkey % 4 AS STRING)) END AS worker_id,
    CASE WHEN status <> 'pending' THEN created_at + INTERVAL 5 MINUTE END AS claimed_at,
    CASE WHEN status <> 'pending' AND o_orderkey % 701 <> 3 THEN created_at + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 6 MINUTE WHEN 1 THEN INTERVAL 15 MINUTE ELSE INTERVAL 30 MINUTE END END AS lease_renewed_at
  FROM (
    SELECT *, CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 37 = 4 THEN 'succeeded' ELSE 'failed' END
        ELSE CASE o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'canceled' WHEN 3 THEN 'failed' ELSE 'succeeded' END END AS status,
      o_orderdate + INTERVAL 3650 DAY + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 0 DAY WHEN 1 THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END AS created_at
    FROM orders) o) a""",
    "result_files": """
SELECT CAST(o_orderkey * 4 + k AS BIGINT) AS id, o_orderkey AS analysis_attempt_id,
  CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE 'chart' END AS kind,
  CASE WHEN k = 2 THEN 'by_month' WHEN k = 3 THEN CASE WHEN o_orderkey % 23 = 0 THEN 'by_month' ELSE 'top_products' END END AS chart_key,
  concat('org/', CAST(o_orderkey % 25 AS STRING), '/result/', CAST(o_orderkey * 4 + k AS STRING)) AS storage_key,
  CAST((o_orderkey * 31 + k) % 1000 AS INT) AS byte_size
FROM orders JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks ON o_orderkey % 9 <> k
WHERE o_orderkey % 3 < 2 AND o_orderkey % 37 = 4 OR o_orderkey % 3 = 2 AND o_orderkey % 8 > 3""",
    "stored_results": """
SELECT id, analysis_attempt_id, kind, CASE WHEN id % 73 = 3 THEN storage_key ELSE concat('org/', CAST(organization_id + CASE WHEN id % 67 = 1 THEN 1 ELSE 0 END AS STRING), '/report/', CAST(report_id + CASE WHEN id % 83 = 6 THEN 1 ELSE 0 END AS STRING),
  '/analysis-attempt/', CAST(analysis_attempt_id + CASE WHEN id % 71 = 2 THEN 1 ELSE 0 END AS STRING), '/result/', CAST(id + CASE WHEN id % 79 = 5 THEN 1 ELSE 0 END AS STRING),
  CASE WHEN id % 61 = 8 THEN '' WHEN id % 59 = 4 THEN '.pdf.png' WHEN kind = 'chart' THEN '.png' WHEN kind = 'pdf' THEN '.pdf' ELSE '.xlsx' END) END AS storage_key
FROM result_files JOIN (SELECT id AS analysis_attempt_id, report_id FROM attempts) a USING (analysis_attempt_id) JOIN (SELECT id AS report_id, organization_id FROM reports) r USING (report_id)""",
    "input_files": """
SELECT id, id AS report_id, concat('org/', CAST(organization_id AS STRING), '/report/', CAST(id AS STRING), '/input/', CAST(id AS STRING), CASE WHEN id % 61 = 8 THEN '.txt' ELSE '.csv' END) AS storage_key,
  CAST(id * 17 % 4000 AS INT) AS byte_size, concat('upload ', CAST(id AS STRING), '.csv') AS original_filename FROM reports WHERE id % 53 <> 6""",
    "objects": """
SELECT storage_key AS key, CAST(byte_size AS BIGINT) AS size FROM input_files WHERE id % 47 <> 9
UNION ALL SELECT replace(storage_key, '.csv', '-original.csv'), CAST(byte_size AS BIGINT) FROM input_files WHERE id % 5 = 0
UNION ALL SELECT concat('org/1/stray/', CAST(s_suppkey AS STRING)), CAST(s_suppkey AS BIGINT) FROM supplier""",
    "rejections": """
SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 25 AS organization_id, l_suppkey AS created_by_user_id,
  CASE l_linenumber WHEN 1 THEN 'invalid_metadata' WHEN 2 THEN 'too_large' WHEN 3 THEN 'bad_columns' WHEN 4 THEN 'unparseable' WHEN 5 THEN 'empty' WHEN 6 THEN 'bad_rows' ELSE 'other' END AS rejection_reason,
  l_shipdate + INTERVAL 3650 DAY AS created_at FROM lineitem WHERE l_returnflag = 'R'""",
    "upload_log": """
SELECT id, CASE WHEN burst THEN CAST(floor(id / 210) AS BIGINT) % 25 ELSE organization_id END AS organization_id, CASE WHEN burst THEN CAST(floor(id / 15) AS BIGINT) % 40 ELSE created_by_user_id END AS user_id,
  CASE WHEN burst THEN first_at + (id % 30) * INTERVAL 4 MINUTE ELSE created_at END AS created_at
FROM (SELECT id, organization_id, created_by_user_id, created_at, CAST(floor(id / 30) AS BIGINT) % 7 = 3 AS burst, min(created_at) OVER (PARTITION BY CAST(floor(id / 30) AS BIGINT)) AS first_at FROM reports) r""",
    "invite_log": """
SELECT id, CASE WHEN burst THEN CAST(floor(id / 20) AS BIGINT) % 25 ELSE organization_id END AS organization_id,
  CASE WHEN burst THEN first_at + (id % 20) * INTERVAL 2 MINUTE ELSE created_at END AS created_at
FROM (SELECT id, organization_id, created_at, CAST(floor(id / 20) AS BIGINT) % 5 = 2 AS burst, min(created_at) OVER (PARTITION BY CAST(floor(id / 20) AS BIGINT)) AS first_at FROM invites) i""",
    # What the audits read: every table with a few planted faults of each kind.
    "kept_accounts": "SELECT id FROM users WHERE id % 181 <> 7",
    "kept_users": "SELECT id FROM users UNION ALL SELECT id FROM users WHERE id % 173 = 9",
    "kept_orgs": """
SELECT id, CASE WHEN id % 9 = 5 THEN 'Same Name' WHEN id % 9 = 6 THEN 'same name' ELSE name END AS name, created_by_user_id + CASE WHEN id % 7 = 2 THEN 10000000 ELSE 0 END AS created_by_user_id FROM orgs
UNION ALL SELECT id, concat(name, '?'), created_by_user_id FROM orgs WHERE id = 3""",
    "kept_members": """
SELECT user_id + CASE WHEN user_id % 73 = 3 THEN 10000000 ELSE 0 END AS user_id, organization_id + CASE WHEN user_id % 71 = 2 THEN 99 ELSE 0 END AS organization_id, CASE WHEN user_id % 67 = 1 THEN 'owner' ELSE role END AS role FROM members
UNION ALL SELECT user_id, organization_id, role FROM members WHERE user_id % 61 = 4""",
    "kept_invites": """
SELECT id, organization_id + CASE WHEN id % 59 = 1 THEN 99 ELSE 0 END AS organization_id, email, CASE WHEN id % 53 = 1 THEN 'lost' ELSE status END AS status, CASE WHEN id % 47 = 1 THEN 'owner' ELSE role END AS role,
  id + CASE WHEN id % 43 = 1 THEN 10000000 ELSE 0 END AS invited_by_user_id FROM invites
UNION ALL SELECT id, organization_id, email, 'revoked', role, NULL FROM invites WHERE id % 91 = 5""",
    "kept_reports": """
SELECT id, organization_id + CASE WHEN id % 83 = 6 THEN 99 ELSE 0 END AS organization_id, created_by_user_id + CASE WHEN id % 79 = 7 THEN 10000000 ELSE 0 END AS created_by_user_id,
  CASE WHEN deleted_at IS NOT NULL THEN created_by_user_id + CASE WHEN id % 3 = 0 THEN 10000000 ELSE 0 END END AS deleted_by_user_id,
  CASE WHEN id % 97 = 4 THEN 'cats' ELSE counts_basis END AS counts_basis, CASE WHEN id % 89 = 5 THEN 'st' ELSE unit_system END AS unit_system, CASE WHEN id % 101 = 6 THEN '{}' WHEN id % 103 = 6 THEN '[1]' ELSE '{"2011-01": 3}' END AS monthly_counts FROM reports
UNION ALL SELECT id, organization_id, NULL, NULL, counts_basis, unit_system, '{"2011-01": 3}' FROM reports WHERE id % 137 = 8""",
    "kept_inputs": """
SELECT id, report_id + CASE WHEN id % 41 = 1 THEN 10000000 ELSE 0 END AS report_id, CASE WHEN id % 137 = 2 THEN 'org/0/report/0/input/0.csv' ELSE storage_key END AS storage_key, byte_size, md5(storage_key) AS sha, id % 113 = 3 AS cut FROM input_files
UNION ALL SELECT id, report_id, concat(storage_key, '~'), byte_size, md5(storage_key), false FROM input_files WHERE id % 139 = 3""",
    "kept_attempts": """
SELECT id, report_id + CASE WHEN id % 211 = 6 THEN 10000000 ELSE 0 END AS report_id, attempt_number, CASE WHEN id % 199 = 3 THEN 'gone' ELSE status END AS status,
  requested_by_user_id + CASE WHEN id % 223 = 6 THEN 10000000 ELSE 0 END AS requested_by_user_id, CASE WHEN id % 191 = 13 THEN 'meteor' ELSE failure_reason END AS failure_reason FROM attempts
UNION ALL SELECT id, report_id, attempt_number + 10, 'failed', NULL, failure_reason FROM attempts WHERE id % 719 = 5""",
    "kept_results": """
SELECT id, analysis_attempt_id + CASE WHEN id % 97 = 1 THEN 1000000000 ELSE 0 END AS analysis_attempt_id, CASE WHEN id % 101 = 1 THEN 'doc' ELSE kind END AS kind, chart_key, storage_key FROM result_files
UNION ALL SELECT id, analysis_attempt_id, kind, chart_key, storage_key FROM result_files WHERE id % 103 = 2""",
    "kept_rejections": """
SELECT id, organization_id + CASE WHEN id % 109 = 1 THEN 99 ELSE 0 END AS organization_id, created_by_user_id + CASE WHEN id % 113 = 2 THEN 10000000 ELSE 0 END AS created_by_user_id, CASE WHEN id % 107 = 1 THEN 'bored' ELSE rejection_reason END AS rejection_reason FROM rejections""",
    "kept_trail": """
SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'superadmin' WHEN 'signup' THEN 'system' WHEN 'purchase' THEN 'ops_manual' ELSE 'robot' END AS actor_kind FROM events
UNION ALL SELECT event_id, 'user' FROM events WHERE event_id % 401 = 2""",
    "heartbeats": """
SELECT user_id AS attempt_id, ts, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 2) AS INT) AS sequence,
  event_type = 'error' AND event_id % 7 = 0 AS cancel, event_type FROM events""",
}


def needed(sql: str) -> list[str]:
    """The names of views and tables that a query mentions."""
    known = [*VIEWS, *TABLES]
    return [n for n in known if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` or a view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    names = needed(sql)
    text = sql.replace("{", "{{").replace("}", "}}")
    renamed = {}
    if name == "cells":  # under one name the key of the lines is the upload's, and what follows needs no further shuffle by it
        text = re.sub(r"\bl_orderkey\b", "upload", text.replace("l_orderkey AS upload", "upload"))
        renamed = {"lineitem": {"l_orderkey": "upload"}}
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}} {n}", text)
    # The table of parts grows with the others: read from files that compress well, it would pass for one to broadcast.
    parts = {n: view(spark, sf_dir, n).withColumnsRenamed(renamed.get(n, {})) for n in names}
    parts = {n: p.hint("merge") if n == "part" else p for n, p in parts.items()}
    if name == "forms":  # a line has a month of its own as a rule, so they are shuffled once, by upload
        parts["lineitem"] = parts["lineitem"].select("l_orderkey", "l_shipdate").repartition("l_orderkey")
    return spark.sql(text, **parts)


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """``sql`` after a WITH of the views, and of the named queries in ``more``, that it needs."""
    ctes = VIEWS | (more or {})
    order: list[str] = []

    def add(text: str) -> None:
        for n in ctes:
            if n not in order and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text):
                add(ctes[n])
                if n not in order:
                    order.append(n)

    add(sql)
    head = ",\n".join(f"{n} AS ({ctes[n]})" for n in order)
    return f"WITH {head}\n{sql}" if head else sql
