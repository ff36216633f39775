"""Attempt housekeeping as table transforms: every sweep takes tables and a moment, and returns the rows it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import ago, sign_in_url


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def claim(attempts: DataFrame, now: str, worker: str, k: int, reports: list[int] | None = None) -> DataFrame:
    """A1: the k oldest pending attempts without a cancel request, as claimed by ``worker``; ties go to the smaller id."""
    free = attempts.where((F.col("status") == "pending") & F.col("cancel_requested_at").isNull())
    if reports is not None:
        free = free.where(F.col("report_id").isin(reports))
    taken = free.orderBy("created_at", "id").limit(k)
    return taken.withColumns({"status": F.lit("processing"), "worker_id": F.lit(worker), "claimed_at": moment(now), "lease_renewed_at": moment(now)})


def load_inputs(attempts: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """A2: attempts with their report and input file; missing_input marks those without."""
    r = reports.select(F.col("id").alias("report_id"), "organization_id", F.col("name").alias("report_name"), "counts_basis", "unit_system")
    f = files.select("report_id", F.col("id").alias("input_file_id"), "storage_key", "byte_size")
    met = attempts.select("id", "report_id", "status").join(r, "report_id").join(f, "report_id", "left")
    return met.withColumn("missing_input", F.col("input_file_id").isNull())


def renew(beats: DataFrame, attempts: DataFrame) -> DataFrame:
    """A3: for rows of id, worker_id: lease held or lost, with the cancel request."""
    own = attempts.where(F.col("status") == "processing").select("id", "worker_id", "cancel_requested_at", F.lit(True).alias("held"))
    met = beats.join(own, ["id", "worker_id"], "left")
    return met.select("id", "worker_id", F.when(F.col("held"), "held").otherwise("lost").alias("lease"), "cancel_requested_at")


def settle_verdicts(verdicts: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    """A4: rows of id, worker_id, verdict, reason: won where the worker still owns the attempt, with the written values."""
    own = attempts.where(F.col("status") == "processing").select("id", "worker_id", "lease_renewed_at", F.lit(True).alias("won"))
    met = verdicts.join(own, ["id", "worker_id"], "left").withColumn("won", F.coalesce("won", F.lit(False)))
    return met.withColumns(
        {
            "status": F.when(F.col("won"), F.col("verdict")),
            "failure_reason": F.when(F.col("won") & (F.col("verdict") == "failed"), F.col("reason")),
            "finished_at": F.when(F.col("won"), F.greatest(moment(now), "lease_renewed_at")),
        }
    )


def is_expired(now: str, lease: int = fixed.LEASE_SECONDS, ceiling: int = fixed.CLAIM_CEILING_SECONDS) -> Column:
    """A5: nobody renews the lease, or the claim is held past its ceiling."""
    late = F.col("lease_renewed_at") < ago(moment(now), lease)
    return F.coalesce(late, F.lit(False)) | F.coalesce(F.col("claimed_at") < ago(moment(now), ceiling), F.lit(False))


def reap(attempts: DataFrame, now: str, worker: str, most: int = fixed.REAPS_PER_SWEEP) -> DataFrame:
    """Expired attempts, longest unrenewed first: canceled where asked for, else failed as abandoned."""
    gone = attempts.where((F.col("status") == "processing") & is_expired(now)).orderBy(F.col("lease_renewed_at").asc_nulls_last(), "id").limit(most)
    asked = F.col("cancel_requested_at").isNotNull()
    return gone.withColumns(
        {
            "status": F.when(asked, "canceled").otherwise("failed"),
            "failure_reason": F.when(~asked, "abandoned"),
            "failure_detail": F.when(~asked, F.concat(F.lit("lease of "), F.coalesce("worker_id", F.lit("nobody")), F.lit(" expired"))),
            "finished_at": F.greatest(moment(now), "lease_renewed_at"),
            "reaped_by_worker_id": F.lit(worker),
        }
    )


def cancel_requested(attempts: DataFrame, now: str) -> DataFrame:
    """All pending attempts with a cancel request."""
    asked = attempts.where((F.col("status") == "pending") & F.col("cancel_requested_at").isNotNull())
    return asked.withColumns({"status": F.lit("canceled"), "finished_at": F.greatest(moment(now), "cancel_requested_at")})


def classify_endings(endings: DataFrame) -> DataFrame:
    """How a run ended, by ordered rules.

    ``endings``: outcome (spawn-failed, exited, signaled), exit_code, signal,
    stderr, read (result, failure, contract-error, read-error, not-read),
    read_reason, read_detail, missing (array), kill, kill_detail. Adds verdict
    (succeeded, failed, canceled, unowned), reason, detail.
    """
    out, code, read, kill = (F.col(c) for c in ("outcome", "exit_code", "read", "kill"))
    exited = out == "exited"
    none_missing = F.size(F.coalesce("missing", F.array().cast("array<string>"))) == 0
    tail = F.when(F.length(F.coalesce("stderr", F.lit(""))) > 0, F.concat(F.lit("\n"), "stderr")).otherwise("")

    def failed(reason, detail) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(F.lit("failed").alias("verdict"), reason.alias("reason"), detail.alias("detail"))

    def ended(verdict: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(verdict).alias("verdict"), none.alias("reason"), none.alias("detail"))

    declared = F.concat(F.lit("result.json declared file(s) never written: "), F.array_join("missing", ", "))
    v = (
        F.when(kill.isin("fenced", "lost"), ended("unowned"))
        .when(kill == "canceled", ended("canceled"))
        .when(out == "spawn-failed", failed("infrastructure", F.concat(F.lit("could not start the child: "), F.coalesce("read_detail", F.lit("")))))
        .when(exited & (code == 0) & (read == "result") & none_missing, ended("succeeded"))
        .when(exited & (code == 1) & (read == "failure"), failed(F.col("read_reason"), F.col("read_detail")))
        .when(kill == "hung", failed("hung", "no progress within the allotted time"))
        .when(kill == "hard-timeout", failed("hard_timeout", "exceeded the hard ceiling"))
        .when(kill == "shutting-down", failed("shut_down", "killed while the worker was shutting down"))
        .when(kill == "contract-violation", failed("contract_violation", F.col("kill_detail")))
        .when(read == "contract-error", failed("contract_violation", F.col("read_detail")))
        .when(read == "read-error", failed("infrastructure", F.col("read_detail")))
        .when(exited & (code == 0), failed("contract_violation", F.when((read == "result") & ~none_missing, declared).otherwise("exited 0 without writing result.json")))
        .when(exited & (code == 1), failed("contract_violation", "exited 1 without writing failure.json"))
        .when(exited & (code == 2), failed("contract_violation", F.concat(F.lit("invoked with the wrong arguments"), tail)))
        .when(out == "signaled", failed("child_crashed", F.concat(F.lit("killed by signal "), F.coalesce("signal", F.lit("")), tail)))
        .otherwise(failed("child_crashed", F.concat(F.lit("exited with code "), F.coalesce(code.cast("string"), F.lit("")), tail)))
    )
    most = fixed.DETAIL_CHARS
    cut = F.when(F.length("v.detail") > most, F.concat(F.substring("v.detail", 1, most), F.lit("… (truncated)"))).otherwise(F.col("v.detail"))
    return endings.withColumn("v", v).select(*endings.columns, "v.verdict", "v.reason", cut.alias("detail"))


def classify_errors(errors: DataFrame) -> DataFrame:
    """Rows of source (database, blob-store, other), code, message: adds transient, reason, detail."""
    code = F.coalesce("code", F.lit(""))
    database, message = F.col("source") == "database", F.coalesce("message", F.lit(""))
    transient = database & (
        code.startswith("08") | code.isin(fixed.TRANSIENT_SQL_STATES) | code.isin(fixed.TRANSIENT_SYSCALLS) | message.isin(fixed.TRANSIENT_MESSAGES)
    )
    detail = (
        F.when(transient, F.concat(F.lit("Could not reach the database: "), message))
        .when(database, F.concat(F.lit("The database refused a statement (SQLSTATE "), F.coalesce("code", F.lit("unknown")), F.lit("): "), message))
        .when(F.col("source") == "blob-store", F.concat(F.lit("Could not reach the blob store: "), message))
        .otherwise(message)
    )
    reason = F.when(database | (F.col("source") == "blob-store"), "infrastructure").otherwise("unknown")
    return errors.withColumns({"transient": transient, "reason": reason, "detail": detail})


def apply_changes(table: DataFrame, changes: DataFrame, key: str, guard: str) -> DataFrame:
    """A10: ``table`` with the rows of ``changes`` (key, guard - its value when read -, new columns) written.

    A change whose guard no longer holds is a no-op: the race was lost.
    """
    new = [c for c in changes.columns if c not in (key, guard)]
    c = changes.select(F.col(key), F.col(guard).alias("__guard"), F.lit(True).alias("__change"), *[F.col(n).alias(f"__{n}") for n in new])
    met = table.join(c, key, "left")
    won = F.coalesce(F.col("__change"), F.lit(False)) & F.col(guard).eqNullSafe(F.col("__guard"))
    return met.select(*[F.when(won, F.col(f"__{n}")).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in table.columns])


def explanations(spark) -> DataFrame:
    """What is said of each failure reason; ten rows."""
    rows = [(r, *v) for r, v in fixed.FAILURE_EXPLANATIONS.items()]
    return spark.createDataFrame(rows, "failure_reason string, what_happened string, follow_up string, follow_up_text string")


def explain(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("failure_reason").isNotNull()).join(F.broadcast(explanations(attempts.sparkSession)), "failure_reason", "left")


def wrong_claimants(claims: DataFrame) -> DataFrame:
    """Rows of reason, claimed_by (parent, child) where that side may not claim the reason."""
    rows = list(fixed.FAILURE_CLAIMANTS.items())
    names = F.broadcast(claims.sparkSession.createDataFrame(rows, "reason string, claimant string"))
    met = claims.join(names, "reason", "left")
    return met.where(F.col("claimant").isNull() | ((F.col("claimant") != "either") & (F.col("claimant") != F.col("claimed_by"))))


def missing_files(declared: DataFrame, written: DataFrame) -> DataFrame:
    """Id, missing (sorted) from rows of id, charts (array) against rows of id, file."""
    names = F.concat(F.array(F.lit("report.pdf"), F.lit("report.xlsx")), F.transform("charts", lambda c: F.concat(F.lit("chart-"), c, F.lit(".png"))))
    wanted = declared.select("id", F.explode(names).alias("file"))
    return wanted.join(written, ["id", "file"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("file")).alias("missing"))


def input_faults(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Files (storage_key, byte_size, checksum) that differ from objects (key, content): size first, then SHA-256."""
    o = objects.select(F.col("key").alias("storage_key"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha"))
    met = files.join(o, "storage_key")
    fault = F.when(F.col("size") != F.col("byte_size"), "size").when(F.col("sha") != F.col("checksum"), "checksum")
    return met.withColumn("fault", fault).where(F.col("fault").isNotNull())


def decide_parked(parked: DataFrame, now: str) -> DataFrame:
    """Rows of stage, since, lease, cancel_requested_at: what to do with a verdict that could not be written."""
    spent = (F.col("stage") == "upload") & (F.col("since") <= ago(moment(now), fixed.UPLOAD_BUDGET_SECONDS))
    action = (
        F.when(F.col("lease") == "lost", "drop-parked-verdict")
        .when(F.col("cancel_requested_at").isNotNull(), "convert-parked-verdict-to-canceled")
        .when(spent, "convert-parked-verdict-to-upload-expired").otherwise("resume-parked-verdict")
    )
    return parked.withColumn("action", action)


def is_due(now: str, base: int = fixed.NOTIFY_BASE_SECONDS, most: int = fixed.NOTIFY_MAX_ATTEMPTS) -> Column:
    """Finished, not canceled, unsent, with attempts left, and the last claim older than base * 2 ** (n - 1)."""
    wait = F.make_dt_interval(secs=F.lit(base) * F.pow(F.lit(2), F.col("notification_attempts") - 1))
    rested = F.col("notification_claimed_at").isNull() | (F.col("notification_claimed_at") < moment(now) - wait)
    return (
        F.col("finished_at").isNotNull() & (F.col("status") != "canceled") & F.col("notification_email_sent_at").isNull()
        & (F.col("notification_attempts") < most) & rested
    )


def due_notifications(attempts: DataFrame, reports: DataFrame, now: str, worker: str, most: int = fixed.NOTIFY_PER_SWEEP) -> DataFrame:
    """The oldest due attempts of reports that are not deleted, claimed with their counter raised."""
    live = reports.where(F.col("deleted_at").isNull()).select(F.col("id").alias("report_id"))
    due = attempts.where(is_due(now) & F.col("requested_by_user_id").isNotNull()).join(live, "report_id", "left_semi")
    due = due.orderBy("finished_at", "id").limit(most)
    return due.withColumns(
        {"notification_claimed_at": moment(now), "notification_claimed_by_worker_id": F.lit(worker), "notification_attempts": F.col("notification_attempts") + 1}
    )


def load_messages(attempts: DataFrame, reports: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    """Attempts with recipient, report and the pdf and xlsx ids; a success without both files is dropped."""
    picked = files.groupBy("analysis_attempt_id").pivot("kind", ["pdf", "xlsx"]).agg(F.min("id"))
    picked = picked.select(F.col("analysis_attempt_id").alias("id"), F.col("pdf").alias("pdf_id"), F.col("xlsx").alias("xlsx_id"))
    r = reports.select(F.col("id").alias("report_id"), "organization_id", F.col("name").alias("report_name"))
    u = users.select(F.col("id").alias("requested_by_user_id"), "email")
    met = attempts.join(r, "report_id").join(u, "requested_by_user_id").join(picked, "id", "left")
    return met.where((F.col("status") != "succeeded") | (F.col("pdf_id").isNotNull() & F.col("xlsx_id").isNotNull()))


def outbox(messages: DataFrame, site: str, support: str, app: str) -> DataFrame:
    """attempt_id, kind, recipient, subject, body of the analysis messages."""
    said = F.broadcast(explanations(messages.sparkSession))
    met = messages.join(said, "failure_reason", "left")
    report = F.concat(F.lit(f"{site}/orgs/"), F.col("organization_id").cast("string"), F.lit("/reports/"), F.col("report_id").cast("string"))

    def file(c: str) -> Column:
        return F.concat(F.lit(f"{site}/file/result/"), F.col(c).cast("string"))

    ok = F.col("status") == "succeeded"
    retry = F.col("follow_up") == "retry"
    contact = F.lit(f"Contact us: mailto:{support}")
    subject = F.concat(F.when(ok, "Your report is ready: ").otherwise("We could not finish your report: "), F.col("report_name"))
    ready = F.concat_ws(
        "\n\n", F.lit("We have finished analysing your procurement data."), F.concat(F.lit("View your report: "), report),
        F.concat(F.lit("Download the PDF: "), file("pdf_id"), F.lit("\nDownload the Excel sheet: "), file("xlsx_id")),
    )
    sorry = F.concat_ws("\n\n", "what_happened", "follow_up_text", F.when(retry, F.concat(F.lit("Try again: "), report)), contact)
    return met.select(
        F.col("id").alias("attempt_id"), F.when(ok, "analysis-succeeded").otherwise("analysis-failed").alias("kind"),
        F.col("email").alias("recipient"), subject.alias("subject"),
        F.concat_ws("\n\n", subject, F.when(ok, ready).otherwise(sorry), F.lit(f"— {app}")).alias("body"),
    )


def invite_messages(invites: DataFrame, orgs: DataFrame, users: DataFrame, site: str, app: str) -> DataFrame:
    """Id, kind, recipient, subject, body of the invitations (id, organization_id, email, role, invited_by_user_id, expires_at).

    An inviter who is gone or has no name is 'An admin'; the expiry is a date in UTC.
    """
    o = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    u = users.select(F.col("id").alias("invited_by_user_id"), F.col("display_name").alias("inviter"))
    met = invites.join(o, "organization_id").join(u, "invited_by_user_id", "left")
    subject = F.concat(F.lit("Join "), F.col("organization"), F.lit(f" on {app}"))
    said = F.concat(F.coalesce("inviter", F.lit("An admin")), F.lit(" invited you to join "), F.col("organization"), F.lit(". Sign in with this email address to accept."))
    facts = F.concat_ws(
        "\n", F.concat(F.lit("Organization: "), "organization"), F.concat(F.lit("Role: "), F.initcap("role")), F.concat(F.lit("Expires: "), F.date_format("expires_at", "MMMM d, yyyy")),
    )
    link = F.concat(F.lit("Accept the invitation: "), sign_in_url(site, F.col("email")))
    return met.select("id", F.lit("organization-invite").alias("kind"), F.col("email").alias("recipient"), subject.alias("subject"), F.concat_ws("\n\n", subject, said, link, facts, F.lit(f"— {app}")).alias("body"))


NOTICES = {
    "organization-created": ("New organization: ", None, "Organization", "Created by"),
    "organization-deleted": ("Organization deleted: ", "Its reports and input files were deleted with it. No user accounts were.", "Organization", "Deleted by"),
    "user-deleted": ("User deleted: ", "Their reports remain with their organizations, showing a deleted user as the submitter.", "Account", None),
}
"""Fixed values: heading, paragraph and the labels of what it is about and who did it."""


def notices(events: DataFrame, operator: str, address: str, app: str) -> DataFrame:
    """Id, kind, recipient, subject, body of the three notices to the operating company.

    ``events``: id, what (a key of NOTICES), name (of the organization, or the
    user's address), actor_email. ``operator`` stands ahead of each kind.
    """
    rows = [(k, *v) for k, v in NOTICES.items()]
    said = events.sparkSession.createDataFrame(rows, "what string, heading string, said string, about string, by string")
    met = events.join(F.broadcast(said), "what")
    subject = F.concat("heading", "name")
    facts = F.concat_ws("\n", F.concat("about", F.lit(": "), "name"), F.concat("by", F.lit(": "), "actor_email"))
    return met.select("id", F.concat(F.lit(f"{operator}-"), "what").alias("kind"), F.lit(address).alias("recipient"), subject.alias("subject"), F.concat_ws("\n\n", subject, "said", facts, F.lit(f"— {app}")).alias("body"))


def retry_window(n: Column, base: int = fixed.NOTIFY_BASE_SECONDS) -> Column:
    """Seconds until the last of n tries: base * (2 ** (n - 1) - 1)."""
    return (F.lit(base) * (F.pow(F.lit(2), n - 1) - 1)).cast("long")
