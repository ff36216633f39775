"""Streams: the same transforms on a static table and on a stream, but for supervision, which has a batch twin.

Lateness: every stream takes its watermark from the caller (``delay``); rows
later than it are dropped, which a static table never does.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from larder.functions import fixed
from larder.operators import findings, rules, uploads
from larder.sources.sinks import commit_batch, read_batches
from larder.sources.store import settle


def read_tables(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """S2 as a stream: parquet files as they arrive."""
    return spark.readStream.schema(like.schema).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Upload, content, size of files as they arrive; ``blobs.scan_uploads`` reads those that are there."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("upload"), "content", F.col("length").alias("size"))


def split_files(files: DataFrame, now: str) -> dict[str, DataFrame]:
    """Refused files, rejected files and accepted rows of one batch of upload, content, size."""
    decoded = settle(uploads.decode(files), "decoded")
    layout = settle(uploads.find_layout(decoded), "layouts")
    rows, later = uploads.data_rows(decoded, layout)
    met = decoded.drop("text", "content").join(layout.withColumnsRenamed({"parse_fault": "lf", "parse_line": "ll"}), "upload", "left").join(later, "upload", "left")
    met = met.withColumns({"parse_fault": F.coalesce("lf", "parse_fault"), "parse_line": F.coalesce("ll", "parse_line")})
    done = findings.normalize(rules.read_cells(rows, now), now)
    return {"refused": uploads.describe_unreadable(met), "rejected": done["rejected"], "accepted": done["accepted"]}


INTAKE = {
    "refused": "upload string, reason string, summary string, detail string",
    "rejected": "upload string",
    "accepted": "upload string, line int, product string, iso string, weight double",
}
"""What each table has before its first batch."""


def intake(files: DataFrame, now: str, out: str, checkpoint: str) -> StreamingQuery:
    """Files of a binaryFile stream to the tables of INTAKE, read by ``sinks.read_batches``.

    A batch's tables appear together; running it again replaces them.
    """
    return files.writeStream.foreachBatch(lambda batch, number: commit_batch(split_files(batch, now), out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(beats: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a gap: attempt_id, start, end, n."""
    w = F.session_window("ts", gap)
    n = beats.withWatermark("ts", delay).groupBy("attempt_id", w.alias("w")).agg(F.count("*").alias("n"))
    return n.select("attempt_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alerts(events: DataFrame, length: str, slide: str | None, limit: float, delay: str = "1 hour") -> DataFrame:
    """Windows whose share of errors is over ``limit``: start, n, errors."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    n = events.withWatermark("ts", delay).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return n.where(F.col("errors") / F.col("n") > limit).select(F.col("w.start").alias("start"), "n", "errors")


def match(claims: DataFrame, finishes: DataFrame, within: str = "2 days", delay: str = "1 hour") -> DataFrame:
    """Claims of key, event, ts with the finishes of the key that follow within a time: key, event, finish, waited."""
    c = claims.withWatermark("ts", delay).select("key", F.col("event").alias("claim"), F.col("ts").alias("claimed_at"))
    f = finishes.withWatermark("ts", delay).select(F.col("key").alias("k"), F.col("event").alias("finish"), F.col("ts").alias("finished_at"))
    cond = (F.col("key") == F.col("k")) & (F.col("finished_at") >= F.col("claimed_at")) & (F.col("finished_at") <= F.col("claimed_at") + F.expr(f"INTERVAL {within}"))
    waited = F.col("finished_at").cast("double") - F.col("claimed_at").cast("double")
    return c.join(f, cond).select("key", "claim", "finish", F.round(waited, 3).alias("waited"))


def once(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """One row for each key within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def rolling(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """W8 on a table: how many events of the key the window that ends with each event holds."""
    order = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("within", F.count("*").over(order))


class Rolling(StatefulProcessor):
    """The times of a key's events as list state; a timer clears it when the window behind the last one has passed."""

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pd.concat(list(rows))
        at = fresh["ts"].astype("datetime64[us]").astype("int64")
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.span
        kept = sorted([t for (t,) in (self.times.get() if self.times.exists() else []) if t >= oldest] + at.tolist())
        self.times.put([(t,) for t in kept])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((kept[-1] + self.span) // 1000 + 1)
        within = [bisect_right(kept, t) - bisect_left(kept, t - self.span) for t in at]
        yield pd.DataFrame({"key": key[0], "event_id": fresh["event_id"].to_numpy(), "within": within})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        self.times.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "within": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rolling_live(events: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """W8 on a stream of key, event_id, ts: how many of the key's events so far the window holds that ends with each.

    An event counts with those of its batch and before; times older than the
    watermark less the window are dropped, and a key without events for a whole
    window has no state. Needs ``use_rocksdb``.
    """
    rows = events.withWatermark("ts", delay).groupBy("key")
    return rows.transformWithStateInPandas(Rolling(seconds), "key long, event_id long, within long", outputMode="append", timeMode="EventTime")


THRESHOLDS = {"hung": fixed.HUNG_SECONDS, "hard-timeout": fixed.HARD_TIMEOUT_SECONDS, "fenced": fixed.LEASE_SECONDS}


def _first_match(cancel: Column, idle: Column, age: Column, lease: Column) -> Column:
    t = THRESHOLDS
    return (
        F.when(cancel, "canceled").when(idle >= t["hung"], "hung").when(age >= t["hard-timeout"], "hard-timeout").when(lease >= t["fenced"], "fenced")
    )


def supervise(beats: DataFrame) -> DataFrame:
    """W2 on a table: attempt_id, event_id, kill - the first tick of each attempt that ends it.

    ``beats``: attempt_id, event_id, ts, sequence, cancel. Progress is a change of
    ``sequence``; the lease counts from the tick before. The first rule that
    holds at a tick wins: canceled, hung, hard-timeout, fenced.
    """
    order = Window.partitionBy("attempt_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    rows = beats.withColumns({"at": at, "before": F.lag("sequence").over(order)})
    moved = F.when(F.col("before").isNull() | (F.col("before") != F.col("sequence")), F.col("at"))
    rows = rows.withColumn("moved", moved)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"progress": F.max("moved").over(so_far), "started": F.min("at").over(so_far), "renewed": F.coalesce(F.lag("at").over(order), F.col("at"))})
    kill = _first_match(F.col("cancel"), F.col("at") - F.col("progress"), F.col("at") - F.col("started"), F.col("at") - F.col("renewed"))
    rows = rows.withColumn("kill", kill).where(F.col("kill").isNotNull())
    return rows.groupBy("attempt_id").agg(F.min_by(F.struct("event_id", "kill"), F.struct("ts", "event_id")).alias("x")).select("attempt_id", "x.event_id", "x.kill")


def supervise_live(beats: DataFrame, delay: str = "1 hour") -> DataFrame:
    """W2 on a stream: the same decisions from state kept for each attempt; an attempt silent past the hard timeout is hung.

    Ticks of a batch are handled in the order of their time, before the timeout;
    a gap between two of them is judged at the later one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame(columns=["attempt_id", "event_id", "kill"])
        if state.hasTimedOut:
            ended = state.get[4]
            state.remove()
            yield none if ended else pd.DataFrame([(key[0], -1, "hung")], columns=none.columns)
            return
        started, progress, renewed, sequence, ended = state.get if state.exists else (0.0, 0.0, 0.0, -1, False)
        fresh, out, at = not state.exists, [], 0.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event, ts, seq, cancel in zip(rows["event_id"], rows["ts"], rows["sequence"], rows["cancel"], strict=True):
            at = ts.timestamp()
            if fresh:
                started, renewed, fresh = at, at, False
            if seq != sequence:
                sequence, progress = int(seq), at
            if not ended:
                waits = {"hung": at - progress, "hard-timeout": at - started, "fenced": at - renewed}
                kill = "canceled" if cancel else next((k for k, s in THRESHOLDS.items() if waits[k] >= s), None)
                if kill:
                    ended = True
                    out.append((key[0], int(event), kill))
            renewed = at
        state.update((started, progress, renewed, sequence, ended))
        state.setTimeoutTimestamp(int((at + THRESHOLDS["hard-timeout"]) * 1000) if at * 1000 > state.getCurrentWatermarkMs() else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame(out, columns=none.columns)

    return beats.withWatermark("ts", delay).groupBy("attempt_id").applyInPandasWithState(
        step, "attempt_id long, event_id long, kill string", "started double, progress double, renewed double, sequence long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def changed(base: DataFrame, out: str, table: str, key: str = "id") -> DataFrame:
    """``base`` with the latest committed change of each row."""
    kept = [c for c in base.columns if c != key]
    last = read_batches(base.sparkSession, out, table, base.schema).groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("x")).select(key, "x.*")
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def sweep(ticks: DataFrame, load: Callable[[], DataFrame], sweeps: list[Callable[[DataFrame, str], DataFrame]], out: str, table: str, checkpoint: str) -> StreamingQuery:
    """At every tick of a stream of ``now``, the sweeps run over the whole table as it is then.

    ``load`` reads the table's rows; each sweep takes them, with all changes so
    far, and the tick's moment, and returns the rows it changes, whole. The sweeps
    of one tick see the same table and must change different rows. Changes are
    committed by tick, so running one again replaces it.
    """

    def at_tick(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("now").cast("string")).first()[0]
        if now is None:
            return
        base = load()
        rows = settle(changed(base, out, table), "table-at-tick")
        parts = [s(rows, now).select(*base.columns) for s in sweeps]
        commit_batch({table: reduce(DataFrame.unionByName, parts)}, out, number)

    return ticks.writeStream.foreachBatch(at_tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An append-only trail as parquet."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
