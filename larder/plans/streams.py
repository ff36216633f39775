"""Stream transforms run on whole tables, with their SQL twins; tests run the streams against these."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import lifecycle
from larder.sources.sinks import read_batches
from larder.sources.store import shared_dir
from larder.sources.views import NOW, view, with_views
from larder.streaming import flows


def _beats(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats, their times drawn together so that attempts live for a while."""
    h = view(spark, d, "heartbeats")
    start = F.lit("2024-01-01").cast("timestamp")
    near = F.timestamp_micros((F.unix_micros(start) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / 100)).cast("long"))
    return h.withColumn("ts", near)


def w_sessions(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessions(_beats(spark, d)).select("attempt_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def w_alerts(spark: SparkSession, d: str) -> DataFrame:
    return flows.alerts(view(spark, d, "events"), "1 hour", None, 0.3).withColumn("start", F.col("start").cast("string"))


def w_alerts_sliding(spark: SparkSession, d: str) -> DataFrame:
    return flows.alerts(view(spark, d, "events"), "2 hours", "1 hour", 0.3).withColumn("start", F.col("start").cast("string"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = view(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return e.where("event_type = 'signup'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")


def w_match(spark: SparkSession, d: str) -> DataFrame:
    return flows.match(*_sides(spark, d))


def w_once(spark: SparkSession, d: str) -> DataFrame:
    return flows.once(view(spark, d, "events").select("user_id", "ts"), "user_id").select("user_id")


def w_rolling(spark: SparkSession, d: str) -> DataFrame:
    return flows.rolling(view(spark, d, "events"), "user_id", 86400).select("event_id", "within")


def w_supervise(spark: SparkSession, d: str) -> DataFrame:
    return flows.supervise(_beats(spark, d))


TICKS = 3


def w_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """Reaping, canceling and claiming of due notifications at three ticks a minute apart: the last state of every changed attempt."""
    at = f"{shared_dir(spark)}/larder/sweeps-{uuid.uuid4().hex}"
    for i in range(TICKS):
        tick = lifecycle.moment(NOW) + F.make_dt_interval(mins=F.lit(i))
        spark.range(1).select(tick.alias("now")).coalesce(1).write.parquet(f"{at}/ticks/{i}")
    ticks = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(f"{at}/ticks")
    reports = view(spark, d, "reports")
    sweeps = [
        lambda rows, now: lifecycle.reap(rows, now, "w7"), lifecycle.cancel_requested, lambda rows, now: lifecycle.due_notifications(rows, reports, now, "w3"),
    ]
    load = lambda: view(spark, d, "attempts").withColumns({c: F.lit(None).cast("string") for c in ("failure_detail", "reaped_by_worker_id")})
    flows.sweep(ticks, load, sweeps, f"{at}/out", "attempts", f"{at}/checkpoint").awaitTermination()
    found = read_batches(spark, f"{at}/out", "attempts", load().schema)
    return found.select("id", F.col("batch").alias("tick"), "status", "failure_reason", "reaped_by_worker_id", "notification_attempts")


def w_trail(spark: SparkSession, d: str) -> DataFrame:
    """Events appended by a stream and read back."""
    at = f"{shared_dir(spark)}/larder/trail-{uuid.uuid4().hex}"
    events = view(spark, d, "events").select("event_id", "user_id", "event_type")
    events.write.parquet(f"{at}/in")
    flows.append(flows.read_tables(spark, f"{at}/in", events), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{at}/out")


QUERIES = {f.__name__: f for f in (w_sessions, w_alerts, w_alerts_sliding, w_match, w_once, w_rolling, w_supervise, w_sweeps, w_trail)}

_C = {
    "beats": "SELECT * REPLACE (make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 100) AS BIGINT)) AS ts) FROM heartbeats",
    "ticks": """SELECT *, max(moved) OVER (PARTITION BY attempt_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress, min(at_) OVER (PARTITION BY attempt_id) AS started, coalesce(lag(at_) OVER (PARTITION BY attempt_id ORDER BY ts, event_id), at_) AS renewed
 FROM (SELECT *, CASE WHEN b IS NULL OR b <> sequence THEN at_ END AS moved FROM (SELECT *, epoch_us(ts) / 1000000.0 AS at_, lag(sequence) OVER (PARTITION BY attempt_id ORDER BY ts, event_id) AS b FROM beats) x) y""",
}
_SQL = {
    "w_sessions": """SELECT attempt_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) + 600000000 AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY attempt_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY attempt_id ORDER BY ts, event_id) < 600000000 THEN 0 ELSE 1 END AS fresh FROM beats) a) b GROUP BY attempt_id, g""",
    "w_alerts": "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') / count(*) > 0.3",
    "w_alerts_sliding": "SELECT CAST(s AS VARCHAR) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) x GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') / count(*) > 0.3",
    "w_match": "SELECT a.user_id AS key, a.event_id AS claim, b.event_id AS finish, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0, 3) AS waited FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY WHERE a.event_type = 'signup' AND b.event_type = 'purchase'",
    "w_once": "SELECT DISTINCT user_id FROM events",
    "w_rolling": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS within FROM events",
    "w_supervise": "SELECT attempt_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(kill, (ts, event_id)) AS kill FROM (SELECT *, CASE WHEN cancel THEN 'canceled' WHEN at_ - progress >= 600 THEN 'hung' WHEN at_ - started >= 1200 THEN 'hard-timeout' WHEN at_ - renewed >= 180 THEN 'fenced' END AS kill FROM ticks) z WHERE kill IS NOT NULL GROUP BY 1",
}
_TS = f"TIMESTAMP '{NOW}'"
_SQL["w_trail"] = "SELECT event_id, user_id, event_type FROM events"
_SQL["w_sweeps"] = f"""SELECT id, tick, status, failure_reason, reaped_by_worker_id, notification_attempts FROM (
 SELECT id, (row_number() OVER (ORDER BY lease_renewed_at NULLS LAST, id) - 1) // 5 AS tick, CASE WHEN cancel_requested_at IS NULL THEN 'failed' ELSE 'canceled' END AS status, CASE WHEN cancel_requested_at IS NULL THEN 'abandoned' END AS failure_reason, 'w7' AS reaped_by_worker_id, notification_attempts
 FROM attempts WHERE status = 'processing' AND (coalesce(lease_renewed_at < {_TS} - INTERVAL 180 SECOND, false) OR coalesce(claimed_at < {_TS} - INTERVAL 1800 SECOND, false))
 UNION ALL SELECT id, 0, 'canceled', failure_reason, NULL, notification_attempts FROM attempts WHERE status = 'pending' AND cancel_requested_at IS NOT NULL
 UNION ALL SELECT a.id, (row_number() OVER (ORDER BY finished_at, a.id) - 1) // 5, status, failure_reason, NULL, notification_attempts + 1 FROM attempts a JOIN reports r ON r.id = report_id AND deleted_at IS NULL
 WHERE requested_by_user_id IS NOT NULL AND finished_at IS NOT NULL AND status <> 'canceled' AND notification_email_sent_at IS NULL AND notification_attempts < 5 AND (notification_claimed_at IS NULL OR notification_claimed_at < {_TS} - to_seconds(300 * pow(2, notification_attempts - 1)))) x
WHERE tick < {TICKS}"""
ORACLE_SQL = {k: with_views(v, _C) for k, v in _SQL.items()}
