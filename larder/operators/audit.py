"""Declared invariants as violation reports: rows of rule, table, key, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import file_extension
from larder.sources.store import settle

_T = "', '".join(fixed.TERMINAL)
# The checks. A check passes on null; it is violated where it is false.
ATTEMPT_CHECKS = {
    "ai_cost_usd_non_negative": "ai_cost_usd >= 0",
    "ai_input_tokens_non_negative": "ai_input_tokens >= 0",
    "ai_output_tokens_non_negative": "ai_output_tokens >= 0",
    "attempt_number_range": "attempt_number >= 1 AND attempt_number <= 5",
    "cancel_requested_at_after_created_at": "cancel_requested_at IS NULL OR cancel_requested_at >= created_at",
    "canceled_is_not_notified": "notification_claimed_at IS NULL OR status <> 'canceled'",
    "canceled_requires_request": "status <> 'canceled' OR cancel_requested_at IS NOT NULL",
    "claimed_at_after_created_at": "claimed_at IS NULL OR claimed_at >= created_at",
    "failure_reason_iff_failed": "(status = 'failed') = (failure_reason IS NOT NULL)",
    "finished_at_after_created_at": "finished_at IS NULL OR finished_at >= created_at",
    "finished_at_after_lease_renewed": "finished_at IS NULL OR lease_renewed_at IS NULL OR finished_at >= lease_renewed_at",
    "finished_at_iff_terminal": f"(status IN ('{_T}')) = (finished_at IS NOT NULL)",
    "lease_renewed_after_claimed_at": "lease_renewed_at IS NULL OR claimed_at IS NULL OR lease_renewed_at >= claimed_at",
    "lease_renewed_after_created_at": "lease_renewed_at IS NULL OR lease_renewed_at >= created_at",
    "notification_attempts_iff_claimed": "(notification_attempts > 0) = (notification_claimed_at IS NOT NULL)",
    "notification_attempts_non_negative": "notification_attempts >= 0",
    "notification_claim_requires_finished": "notification_claimed_at IS NULL OR finished_at IS NOT NULL",
    "notification_claimed_by_iff_claimed": "(notification_claimed_at IS NOT NULL) = (notification_claimed_by_worker_id IS NOT NULL)",
    "notification_requires_finished": "notification_email_sent_at IS NULL OR finished_at IS NOT NULL",
    "notification_sent_requires_claim": "notification_email_sent_at IS NULL OR notification_claimed_at IS NOT NULL",
    "pending_is_unclaimed": "status <> 'pending' OR (worker_id IS NULL AND claimed_at IS NULL AND lease_renewed_at IS NULL)",
    "processing_is_claimed": "status <> 'processing' OR (worker_id IS NOT NULL AND claimed_at IS NOT NULL AND lease_renewed_at IS NOT NULL AND finished_at IS NULL)",
}
OTHER_CHECKS = {
    "users": {"created_count_max": "organizations_created_count <= 5", "created_count_non_negative": "organizations_created_count >= 0"},
    "invites": {"email_is_lowercase": "email = lower(email)", "expires_at_after_created_at": "expires_at > created_at"},
    "reports": {"deleted_at_after_created_at": "deleted_at IS NULL OR deleted_at >= created_at"},
    "input_files": {"byte_size_positive": "byte_size > 0"},
    "kept_inputs": {"byte_size_positive": "byte_size > 0", "checksum_length": "octet_length(checksum) = 32"},
    "kept_reports": {"counts_is_object": "substr(monthly_counts, 1, 1) = '{'", "counts_not_empty": "monthly_counts <> '{}'"},
    "result_files": {"byte_size_positive": "byte_size > 0", "chart_key_iff_chart": "(kind = 'chart') = (chart_key IS NOT NULL)"},
}


def violations(df: DataFrame, table: str, checks: dict[str, str], key: str = "id") -> DataFrame:
    """One row for each broken check of each row, in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(f"coalesce(({sql}), true)"), name) for name, sql in checks.items()]))
    found = df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))
    return found.select("rule", F.lit(table).alias("table"), "key")


def vocabularies(manual: str) -> dict[str, dict[str, list[str]]]:
    """The nine vocabularies, by table and column; ``manual`` names the operating company's hand-made audit entries."""
    return {
        "attempts": {"status": fixed.ATTEMPT_STATUSES, "failure_reason": list(fixed.FAILURE_CLAIMANTS)},
        "reports": {"counts_basis": fixed.COUNTS_BASES, "unit_system": fixed.UNIT_SYSTEMS},
        "members": {"role": fixed.ROLES},
        "invites": {"status": fixed.INVITE_STATUSES, "role": fixed.ROLES},
        "results": {"kind": list(fixed.RESULT_KINDS)},
        "rejections": {"rejection_reason": fixed.REJECTION_REASONS},
        "trail": {"actor_kind": [*fixed.AUDIT_ACTOR_KINDS, manual]},
    }


UNIQUE = {
    "attempts": {"pkey": (["id"], None), "report_attempt": (["report_id", "attempt_number"], None), "one_active": (["report_id"], "status IN ('pending', 'processing')")},
    "users": {"pkey": (["id"], None)},
    "trail": {"pkey": (["id"], None)},
    "inputs": {"pkey": (["id"], None), "report": (["report_id"], None), "storage_key": (["storage_key"], None)},
    "invites": {"pkey": (["id"], None), "one_pending": (["organization_id", "email"], "status = 'pending'")},
    "members": {"pkey": (["user_id", "organization_id"], None)},
    "orgs": {"pkey": (["id"], None), "name": (["lower(name)"], None)},
    "rejections": {"pkey": (["id"], None)},
    "reports": {"pkey": (["id"], None)},
    "results": {
        "pkey": (["id"], None), "storage_key": (["storage_key"], None), "one_pdf": (["analysis_attempt_id"], "kind = 'pdf'"), "one_xlsx": (["analysis_attempt_id"], "kind = 'xlsx'"),
        "one_chart": (["analysis_attempt_id", "chart_key"], "kind = 'chart'"),
    },
}
"""I4, I5: by table and rule: the columns, and the rows that the rule is about."""
EDGES = {
    "attempts": {"report_id": "reports", "requested_by_user_id": "users"},
    "users": {"id": "accounts"},
    "inputs": {"report_id": "reports"},
    "orgs": {"created_by_user_id": "users"},
    "invites": {"invited_by_user_id": "users", "organization_id": "orgs"},
    "members": {"organization_id": "orgs", "user_id": "users"},
    "rejections": {"created_by_user_id": "users", "organization_id": "orgs"},
    "reports": {"created_by_user_id": "users", "deleted_by_user_id": "users", "organization_id": "orgs"},
    "results": {"analysis_attempt_id": "attempts"},
}
"""I6: by table and column, the table whose id it must be; fifteen in all."""
FEW = 100_000
"""Lost keys are broadcast up to so many; each is a number and two names."""


def row_key(table: str) -> Column:
    """How a report names a row."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in (["user_id", "organization_id"] if table == "members" else ["id"])])


def outside_vocabularies(df: DataFrame, table: str, columns: dict[str, list[str]]) -> DataFrame:
    """Non-null values that a column's vocabulary lacks, all columns in one pass: rule, table, key."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), f"{c}_vocabulary") for c, v in columns.items()]))
    return df.select(F.explode(bad).alias("rule"), F.lit(table).alias("table"), row_key(table).alias("key"))


def duplicates(df: DataFrame, table: str, rules: dict[str, tuple[list[str], str | None]]) -> DataFrame:
    """Rule, table, key, n of keys that occur more than once; all rules of a table in one pass and one shuffle.

    Nulls are distinct from each other, as in a unique index. Counts combine
    before the shuffle, so a key that a third of all rows share is no hot key.
    """
    each = []
    for rule, (columns, where) in rules.items():
        known = F.expr(" AND ".join([f"({c}) IS NOT NULL" for c in columns] + ([f"({where})"] if where else [])))
        each.append(F.when(known, F.struct(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.expr(c).cast("string") for c in columns]).alias("key"))))
    rows = df.select(F.inline(F.array_compact(F.array(*each))))
    n = rows.groupBy("rule", "key").agg(F.count("*").alias("n")).where("n > 1")
    return n.select("rule", F.lit(table).alias("table"), "key", "n")


def orphans(tables: dict[str, DataFrame], edges: dict[str, dict[str, str]]) -> DataFrame:
    """Rule, table, key of the rows whose non-null foreign key no parent has.

    All edges meet in one anti-join, of distinct keys only: millions of children of
    one parent are one row there. The children are read again for the few lost
    keys, which are broadcast while there are not more than FEW.
    """
    values = lambda t, df: F.inline(F.filter(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("rule"), F.lit(p).alias("parent"), F.col(c).cast("string").alias("value")) for c, p in edges[t].items()]), lambda x: x["value"].isNotNull()))  # noqa: E731, ARG005
    asked = reduce(DataFrame.unionByName, [tables[t].select(values(t, tables[t])).distinct() for t in edges])
    parents = sorted({p for of in edges.values() for p in of.values()})
    known = reduce(DataFrame.unionByName, [tables[p].select(F.lit(p).alias("parent"), F.col("id").cast("string").alias("value")) for p in parents])
    lost = settle(asked.join(known, ["parent", "value"], "left_anti").select("rule", "value"), "lost-keys")
    lost = F.broadcast(lost) if lost.limit(FEW + 1).count() <= FEW else lost
    children = reduce(DataFrame.unionByName, [tables[t].select(F.lit(t).alias("table"), row_key(t).alias("key"), values(t, tables[t])) for t in edges])
    return children.join(lost, ["rule", "value"], "left_semi").select("rule", "table", "key")


def retry_faults(attempts: DataFrame) -> DataFrame:
    """Numbers start at 1, rise by 1, follow only a failure, and end at 5."""
    order = Window.partitionBy("report_id").orderBy("attempt_number", "id")
    seen = attempts.select("id", "report_id", "attempt_number", F.lag("attempt_number").over(order).alias("n"), F.lag("status").over(order).alias("s"))
    fault = (
        F.when(F.col("attempt_number") > fixed.MAX_ATTEMPTS, "too-many")
        .when(F.col("n").isNull() & (F.col("attempt_number") != 1), "first-is-not-one")
        .when(F.col("attempt_number") != F.col("n") + 1, "gap").when(F.col("s") != "failed", "after-no-failure")
    )
    return seen.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("id", "report_id", "fault")


def changed_when_frozen(old: DataFrame, new: DataFrame, may_change: list[str], key: str = "id") -> DataFrame:
    """I8: terminal rows of the old snapshot that differ in the new one, but for the columns that may change; or are gone."""
    kept = [c for c in old.columns if c not in (*may_change, key)]
    o = old.where(F.col("status").isin(fixed.TERMINAL)).select(key, F.struct(*kept).alias("o"))
    n = new.select(key, F.struct(*kept).alias("n"), F.lit(True).alias("there"))
    met = o.join(n, key, "left")
    return met.where(F.col("there").isNull() | ~F.col("o").eqNullSafe(F.col("n"))).select(F.col(key), F.when(F.col("there").isNull(), "deleted").otherwise("changed").alias("fault"))


def trail_faults(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of an append-only trail that were changed or deleted."""
    o = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("o"))
    n = new.select(key, F.struct(*[c for c in old.columns if c != key]).alias("n"), F.lit(True).alias("there"))
    met = o.join(n, key, "left")
    return met.where(F.col("there").isNull() | ~F.col("o").eqNullSafe(F.col("n"))).select(F.col(key), F.when(F.col("there").isNull(), "deleted").otherwise("changed").alias("fault"))


def without_admin(orgs: DataFrame, members: DataFrame) -> DataFrame:
    """Organizations without a member or an admin."""
    n = members.groupBy(F.col("organization_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "admin").alias("admins"))
    met = orgs.join(n, "id", "left")
    fault = F.when(F.coalesce("n", F.lit(0)) == 0, "no-member").when(F.col("admins") == 0, "no-admin")
    return met.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("id", "fault")


def low_counters(users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Users whose counter is below the organizations they are seen to have created."""
    seen = orgs.groupBy(F.col("created_by_user_id").alias("id")).agg(F.count("*").alias("observed"))
    return users.join(seen, "id").where(F.col("organizations_created_count") < F.col("observed")).select("id", "organizations_created_count", "observed")


def dangling(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows without an object and objects without a row; originals beside a file are no orphans."""
    rows = files.join(objects.select(F.col("key").alias("storage_key")), "storage_key", "left_anti").select(F.lit("dangling").alias("fault"), F.col("storage_key").alias("key"))
    owner = F.regexp_replace("key", r"-original\.csv\z", ".csv")
    stray = objects.withColumn("storage_key", owner).join(files.select("storage_key"), "storage_key", "left_anti").select(F.lit("orphan").alias("fault"), "key")
    return rows.unionByName(stray)


def wrong_keys(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Input files whose key is not the one built from their row."""
    r = reports.select(F.col("id").alias("report_id"), "organization_id")
    s = lambda c: F.col(c).cast("string")
    expected = F.concat_ws("/", F.lit("org"), s("organization_id"), F.lit("report"), s("report_id"), F.lit("input"), F.concat(s("id"), F.lit(".csv")))
    return files.join(r, "report_id").withColumn("expected", expected).where(F.col("storage_key") != F.col("expected")).select("id", "storage_key", "expected")


def wrong_result_keys(files: DataFrame, attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """Result files whose key is not their row's: id, storage_key, faults in the order of the key's segments.

    ``files``: id, analysis_attempt_id, kind, storage_key. A key of another shape
    has the one fault shape. A null key and a row without its attempt or report
    are left to the null and foreign key audits.
    """
    made = attempts.select(F.col("id").alias("analysis_attempt_id"), "report_id")
    owned = reports.select(F.col("id").alias("report_id"), "organization_id")
    met = files.select("id", "analysis_attempt_id", "kind", "storage_key").join(made, "analysis_attempt_id").join(owned, "report_id")
    p = F.split("storage_key", "/")
    part = lambda i: F.get(p, F.lit(i))
    labels = {0: "org", 2: "report", 4: "analysis-attempt", 6: "result"}
    shaped = reduce(lambda a, b: a & b, [part(i) == v for i, v in labels.items()], F.size(p) == 8)
    name = F.split(part(7), "[.]", 2)
    segments = {
        "organization": part(1) != F.col("organization_id").cast("string"),
        "report": part(3) != F.col("report_id").cast("string"),
        "attempt": part(5) != F.col("analysis_attempt_id").cast("string"),
        "id": F.get(name, F.lit(0)) != F.col("id").cast("string"),
        "extension": F.coalesce(F.get(name, F.lit(1)), F.lit("")) != file_extension(F.col("kind")),
    }
    faults = F.when(~F.coalesce(shaped, F.lit(False)), F.lit("shape")).otherwise(F.concat_ws(",", *[F.when(bad, n) for n, bad in segments.items()]))
    return met.where(F.col("storage_key").isNotNull()).select("id", "storage_key", faults.alias("faults")).where(F.col("faults") != "")
