"""Who may see and do what, and the product's reading queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators.lifecycle import moment


FEW = 100_000
"""Organizations are given to each superadmin as a list up to so many."""


def access(users: DataFrame, orgs: DataFrame, members: DataFrame) -> DataFrame:
    """Q3: user_id, organization_id, role: memberships, and every organization as admin for superadmins.

    Every pair of a superadmin and an organization is a row of the result, which
    is what this table is; to check pairs or to count, ``check_access`` and
    ``destinations`` go by the flag and make none.
    """
    supers = users.where("is_superadmin").select(F.col("id").alias("user_id"))
    own = members.join(supers, "user_id", "left_anti").select("user_id", "organization_id", "role")
    every = orgs.agg(F.collect_list("id").alias("ids")) if orgs.limit(FEW + 1).count() <= FEW else None
    if every is not None:  # counted: each superadmin's row is given the list and expanded where it is
        all_ = supers.join(F.broadcast(every)).select("user_id", F.explode("ids").alias("organization_id"))
    else:
        all_ = supers.join(orgs.select(F.col("id").alias("organization_id")))
    return own.unionByName(all_.select("user_id", "organization_id", F.lit("admin").alias("role")))


def check_access(pairs: DataFrame, users: DataFrame, orgs: DataFrame, members: DataFrame) -> DataFrame:
    """Q4: for pairs of user_id, organization_id, needs_admin: 200, 404 without access, 403 without the role.

    A superadmin is an admin of every organization that exists.
    """
    supers = users.where("is_superadmin").select(F.col("id").alias("user_id"), F.lit(True).alias("super"))
    there = orgs.select(F.col("id").alias("organization_id"), F.lit(True).alias("there"))
    met = pairs.join(members.select("user_id", "organization_id", "role"), ["user_id", "organization_id"], "left").join(supers, "user_id", "left").join(there, "organization_id", "left")
    met = met.withColumn("role", F.when(F.col("super"), F.when(F.col("there"), "admin")).otherwise(F.col("role"))).drop("super", "there")
    status = F.when(F.col("role").isNull(), 404).when(F.col("needs_admin") & (F.col("role") != "admin"), 403).otherwise(200)
    return met.withColumn("status", status)


def live_invites(invites: DataFrame, now: str) -> DataFrame:
    """Q6: pending and not expired; the stored status alone is not trusted."""
    return invites.where((F.col("status") == "pending") & (F.col("expires_at") > moment(now)))


def destinations(users: DataFrame, orgs: DataFrame, members: DataFrame, live: DataFrame) -> DataFrame:
    """Q5: where each user lands: a live invite first, then none, the single organization, or a choice; superadmins have them all."""
    invited = live.select(F.lower("email").alias("email")).distinct().withColumn("invited", F.lit(True))
    n = members.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    met = users.select("id", F.lower("email").alias("email"), "is_superadmin").join(invited, "email", "left").join(n, "id", "left")
    met = met.join(F.broadcast(orgs.agg(F.count("*").alias("every"))))  # one row
    count = F.when(F.col("is_superadmin"), F.col("every")).otherwise(F.coalesce("n", F.lit(0)))
    where = F.when(F.col("invited"), "invite").when(count == 0, "none").when(count == 1, "single").otherwise("pick")
    return met.select("id", where.alias("destination"))


def resolve_invites(invites: DataFrame, now: str) -> DataFrame:
    """Q7: the state on reading: expired by time, superseded by a newer pending invite to the same address."""
    pending = F.col("status") == "pending"
    order = Window.partitionBy("organization_id", F.lower("email"), pending).orderBy(F.desc("created_at"), F.desc("id"))
    ranked = invites.withColumn("i", F.row_number().over(order))
    state = F.when(pending & (F.col("i") > 1), "superseded").when(pending & (F.col("expires_at") <= moment(now)), "expired").otherwise(F.col("status"))
    return ranked.select("id", state.alias("state"))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """report_id and the attempt with the highest number (ties: highest id)."""
    last = F.max(F.struct("attempt_number", "id", "status", "failure_reason", "created_at", "claimed_at")).alias("last")
    return attempts.groupBy("report_id").agg(last).select("report_id", F.col("last.id").alias("attempt_id"), "last.attempt_number", "last.status", "last.failure_reason", F.col("last.created_at").alias("queued_at"), "last.claimed_at")


def report_list(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """Q8: reports that are not deleted with their latest attempt, and their place, newest first, in the organization."""
    order = Window.partitionBy("organization_id").orderBy(F.desc("created_at"), F.desc("id"))
    live = reports.where(F.col("deleted_at").isNull()).withColumn("place", F.row_number().over(order))
    return live.join(latest_attempts(attempts), live["id"] == F.col("report_id"), "left").drop("report_id")


def report_detail(reports: DataFrame, inputs: DataFrame, attempts: DataFrame, files: DataFrame) -> DataFrame:
    """Q9: report, its input file, latest attempt and that attempt's files, nested."""
    nested = files.groupBy(F.col("analysis_attempt_id").alias("attempt_id")).agg(F.array_sort(F.collect_list(F.struct("id", "kind", "chart_key"))).alias("files"))
    i = inputs.select(F.col("report_id").alias("id"), "original_filename")
    last = latest_attempts(attempts).withColumnRenamed("report_id", "id")
    return reports.where(F.col("deleted_at").isNull()).join(i, "id", "left").join(last, "id", "left").join(nested, "attempt_id", "left")


def timeline(attempts: DataFrame) -> DataFrame:
    """Q10: attempt_id, event, at - one row for each moment that is set."""
    names = {"created": "created_at", "claimed": "claimed_at", "renewed": "lease_renewed_at", "cancel-requested": "cancel_requested_at", "finished": "finished_at", "notified": "notification_email_sent_at"}
    each = F.array(*[F.struct(F.lit(n).alias("event"), F.col(c).alias("at")) for n, c in names.items()])
    return attempts.select(F.col("id").alias("attempt_id"), F.inline(F.filter(each, lambda e: e["at"].isNotNull())))


def input_links(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Q11: input files of reports that are not deleted."""
    live = reports.where(F.col("deleted_at").isNull()).select(F.col("id").alias("report_id"), "organization_id")
    return files.join(live, "report_id").select("id", "storage_key", F.col("original_filename").alias("filename"))


def result_links(files: DataFrame, attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """Q12: result files of live reports; a file name for documents, none for charts."""
    live = reports.where(F.col("deleted_at").isNull()).select(F.col("id").alias("report_id"), F.col("name").alias("report_name"))
    a = attempts.select(F.col("id").alias("analysis_attempt_id"), "report_id")
    met = files.join(a, "analysis_attempt_id").join(live, "report_id")
    return met.select("id", "storage_key", F.when(F.col("kind") != "chart", F.concat_ws(".", "report_name", "kind")).alias("filename"))


def soft_delete(reports: DataFrame, attempts: DataFrame, gone: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Q13: changes to reports (deleted_at) and to their active attempts (cancel_requested_at)."""
    r = reports.where(F.col("deleted_at").isNull()).join(gone, "id", "left_semi")
    a = attempts.where(F.col("status").isin("pending", "processing") & F.col("cancel_requested_at").isNull()).join(r.select(F.col("id").alias("report_id")), "report_id", "left_semi")
    return r.select("id", moment(now).alias("deleted_at")), a.select("id", moment(now).alias("cancel_requested_at"))


def sole_admins(members: DataFrame) -> DataFrame:
    """Q14: user_id, organization_id where the user is the only admin."""
    admins = members.where("role = 'admin'").groupBy("organization_id").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id"))
    return admins.where("n = 1").select("user_id", "organization_id")


def roster(members: DataFrame, users: DataFrame, live: DataFrame) -> DataFrame:
    """Q15: organization_id, who, role, kind (member, invited); superadmins are not shown."""
    u = users.where("NOT is_superadmin").select(F.col("id").alias("user_id"), F.col("display_name").alias("who"))
    here = members.join(u, "user_id").select("organization_id", "who", "role", F.lit("member").alias("kind"))
    return here.unionByName(live.select("organization_id", F.col("email").alias("who"), "role", F.lit("invited").alias("kind")))


def rolling_counts(events: DataFrame, by: str, at: str, seconds: dict[str, int], key: str = "id") -> DataFrame:
    """Q17: key, ``by`` and, for each name, how many events of the same ``by`` lie in the window of so many seconds that ends with the event.

    Both ends count, in whole seconds; rows without ``by`` have no window. Time is
    cut in buckets. A count is the difference of two positions, each the events of
    all earlier buckets, from prefix sums over the buckets, and those of its own
    bucket up to it. So what one task gathers is a bucket of a key, or a key's
    buckets, never a key's events.
    """
    width = max(min(seconds.values()) // 4, 1)
    t = F.unix_timestamp(at)
    ends = [F.struct(t.alias("x"), F.lit(1).alias("own"), F.lit("").alias("name"))]
    ends += [F.struct((t - s - 1).alias("x"), F.lit(0).alias("own"), F.lit(n).alias("name")) for n, s in seconds.items()]
    rows = events.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(by).alias("by"), F.inline(F.array(*ends)))
    rows = rows.withColumn("bucket", F.floor(F.col("x") / width))
    inside = Window.partitionBy("by", "bucket").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    buckets = rows.groupBy("by", "bucket").agg(F.sum("own").alias("n"))
    earlier = Window.partitionBy("by").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("by", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = rows.withColumn("here", F.sum("own").over(inside)).join(buckets, ["by", "bucket"])
    place = F.col("here") + F.col("before")
    up_to = lambda n: F.max(F.when(F.col("name") == n, place))
    found = placed.groupBy("key", "by").agg(*[(up_to("") - up_to(n)).alias(n) for n in seconds])
    return found.withColumnsRenamed({"key": key, "by": by})


def rate_breaks(events: DataFrame, by: str, at: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Q17: id, limit, key, n of events that were over a limit of their ``by``; ``limits``: name to (seconds, most)."""
    n = rolling_counts(events, by, at, {name: s for name, (s, _) in limits.items()})
    over = F.filter(F.array(*[F.struct(F.lit(name).alias("limit"), F.col(name).alias("n"), F.lit(most).alias("most")) for name, (_, most) in limits.items()]), lambda x: x["n"] > x["most"])
    return n.select("id", F.col(by).cast("long").alias("key"), F.inline(over)).drop("most")


def allowance(events: DataFrame, by: str, at: str, now: str) -> DataFrame:
    """Q16: uploads left per key: the smaller of what the hour and the week leave."""
    t = moment(now)
    recent = F.count_if(F.col(at) > t - F.expr("INTERVAL 1 HOUR")), F.count_if(F.col(at) > t - F.expr("INTERVAL 7 DAY"))
    left = events.where((F.col(at) <= t) & F.col(by).isNotNull()).groupBy(by).agg(recent[0].alias("hour"), recent[1].alias("week"))
    rest = F.least(F.lit(fixed.UPLOADS_PER_HOUR) - F.col("hour"), F.lit(fixed.UPLOADS_PER_WEEK) - F.col("week"))
    return left.select(by, F.greatest(rest, F.lit(0)).alias("left"))


def upload_allowance(members: DataFrame, events: DataFrame, at: str, now: str) -> DataFrame:
    """Q16: user_id, organization_id, left for each member: the smaller of what the organization and the user have left."""
    whole = F.lit(min(fixed.UPLOADS_PER_HOUR, fixed.UPLOADS_PER_WEEK))
    met = members.select("user_id", "organization_id")
    for by, name in (("organization_id", "of_org"), ("user_id", "of_user")):
        met = met.join(allowance(events, by, at, now).withColumnRenamed("left", name), by, "left")
    return met.select("user_id", "organization_id", F.least(F.coalesce("of_org", whole), F.coalesce("of_user", whole)).alias("left"))


def permissions(granted: DataFrame) -> DataFrame:
    """Q19: user_id, organization_id, permission."""
    rows = [(role, p) for p, roles in fixed.PERMISSIONS.items() for role in roles]
    return granted.join(F.broadcast(granted.sparkSession.createDataFrame(rows, "role string, permission string")), "role").select("user_id", "organization_id", "permission")


def trail(events: DataFrame, by: str, at: str, key: str, n: int) -> DataFrame:
    """Q20: the newest n of each key."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(key))
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def screen_state(latest: DataFrame, explained: DataFrame, now: str, overrun: int) -> DataFrame:
    """Q21: what a report's screen shows, and whether its stage has lasted longer than ``overrun`` seconds."""
    met = latest.join(explained, "failure_reason", "left")
    state = (
        F.when(F.col("status") == "pending", "queued").when(F.col("status") == "failed", F.concat(F.lit("failed-"), F.coalesce("follow_up", F.lit("contact")))).otherwise(F.col("status"))
    )
    since = F.when(F.col("status") == "pending", F.col("queued_at")).when(F.col("status") == "processing", F.col("claimed_at"))
    late = F.coalesce(F.unix_timestamp(moment(now)) - F.unix_timestamp(since) > overrun, F.lit(False))
    return met.select("report_id", state.alias("state"), late.alias("overrun"), F.col("status").isin(fixed.TERMINAL).alias("may_retry"))


def retryable(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """Q22: reports whose latest attempt failed, with numbers left and none active; next_number."""
    active = attempts.where(F.col("status").isin("pending", "processing")).select("report_id").distinct()
    live = reports.where(F.col("deleted_at").isNull()).select(F.col("id").alias("report_id"))
    last = latest_attempts(attempts).where((F.col("status") == "failed") & (F.col("attempt_number") < fixed.MAX_ATTEMPTS))
    return last.join(live, "report_id", "left_semi").join(active, "report_id", "left_anti").select("report_id", (F.col("attempt_number") + 1).alias("next_number"))


def closure(orgs: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Q1: the ids that go with the given organizations, table by table along the cascades."""
    org = orgs.select(F.col("id").alias("organization_id"))
    reports = tables["reports"].join(org, "organization_id", "left_semi").select("id")
    r = reports.select(F.col("id").alias("report_id"))
    attempts = tables["attempts"].join(r, "report_id", "left_semi").select("id")
    return {
        "members": tables["members"].join(org, "organization_id", "left_semi").select(F.col("user_id").alias("id")),
        "invites": tables["invites"].join(org, "organization_id", "left_semi").select("id"),
        "rejections": tables["rejections"].join(org, "organization_id", "left_semi").select("id"),
        "reports": reports,
        "input_files": tables["input_files"].join(r, "report_id", "left_semi").select("id"),
        "attempts": attempts,
        "result_files": tables["result_files"].join(attempts.select(F.col("id").alias("analysis_attempt_id")), "analysis_attempt_id", "left_semi").select("id"),
    }


def forget_user(gone: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Q2: ``df`` with references to the given users (id) set to null."""
    g = gone.select(F.col("id").alias(column), F.lit(True).alias("__gone"))
    return df.join(g, column, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*df.columns)
