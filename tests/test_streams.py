"""Streams give what their table twins give."""

import pytest
from pyspark.sql import functions as F

from larder.operators import lifecycle
from larder.plans import streams
from larder.sources.sinks import read_batches
from larder.sources.views import view
from larder.streaming import flows

from conftest import DATA


def _stream(spark, df, folder):
    df.coalesce(1).write.parquet(str(folder))
    return flows.read_tables(spark, str(folder), df)


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_supervision(spark, tmp_path):
    beats = streams._beats(spark, DATA).select("attempt_id", "event_id", "ts", "sequence", "cancel")
    live = _run(flows.supervise_live(_stream(spark, beats, tmp_path / "in")), "kills").where("event_id >= 0")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, flows.supervise(beats).collect()))


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    flows.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def test_rolling(spark, tmp_path, rocksdb):
    events = view(spark, DATA, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    live = _run(flows.rolling_live(_stream(spark, events, tmp_path / "in"), 86400), "rolls").select("event_id", "within")
    table = flows.rolling(events, "key", 86400).select("event_id", "within")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, table.collect()))


def test_rolling_state_goes(spark, tmp_path, rocksdb):
    """Batches in order give the table's counts; a week after a key's last event nothing of it is left."""
    days = [(1, 1, 1), (1, 2, 2), (2, 3, 3), (1, 4, 8), (2, 5, 9), (3, 6, 40), (3, 7, 41)]
    rows = spark.createDataFrame(days, "key long, event_id long, day int").select("key", "event_id", F.expr("timestamp'2024-01-01' + make_dt_interval(day)").alias("ts"))
    for i in range(len(days)):
        rows.where(F.col("event_id") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    checkpoint = str(tmp_path / "checkpoint")
    live = flows.rolling_live(stream, 7 * 86400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint)
    live.trigger(availableNow=True).start().awaitTermination(120)
    table = flows.rolling(rows, "key", 7 * 86400).select("event_id", "within")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("event_id", "within").collect())) == sorted(map(tuple, table.collect()))
    state = spark.read.format("statestore").option("stateVarName", "times").load(checkpoint)
    assert {r[0] for r in state.select("key.key").collect()} == {3}


def test_sweeps_see_the_whole_table(spark, tmp_path):
    """An attempt that comes with the first tick and expires by the third is reaped at the third."""
    attempts = view(spark, DATA, "attempts").withColumns({c: F.lit(None).cast("string") for c in ("failure_detail", "reaped_by_worker_id")})
    at = lambda minute: F.lit(f"2011-12-31 12:0{minute}:00").cast("timestamp")
    fresh = attempts.limit(1).withColumns({"status": F.lit("processing"), "claimed_at": at(0), "lease_renewed_at": at(0), "cancel_requested_at": F.lit(None).cast("timestamp")})
    fresh.write.parquet(str(tmp_path / "attempts"))
    for minute in (1, 2, 4, 5):
        spark.range(1).select(at(minute).alias("now")).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "ticks"))
    load = lambda: spark.read.schema(fresh.schema).parquet(str(tmp_path / "attempts"))
    out = str(tmp_path / "out")
    flows.sweep(ticks, load, [lambda rows, now: lifecycle.reap(rows, now, "w7")], out, "attempts", str(tmp_path / "ck")).awaitTermination(120)
    assert [(r.batch, r.status, r.failure_reason) for r in read_batches(spark, out, "attempts", fresh.schema).collect()] == [(2, "failed", "abandoned")]
    assert [r.status for r in flows.changed(load(), out, "attempts").collect()] == ["failed"]


@pytest.mark.parametrize("name", ["w_sweeps", "w_trail", "w_rolling"])
def test_twin(same, name):
    same(streams.QUERIES[name], streams.ORACLE_SQL[name])


def test_match(spark, tmp_path):
    claims, finishes = streams._sides(spark, DATA)
    live = _run(flows.match(_stream(spark, claims, tmp_path / "a"), _stream(spark, finishes, tmp_path / "b")), "matches")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, flows.match(claims, finishes).collect()))


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.csv").write_text("product,date,weight\nbeef,2011-01-05,2.50\n")
    (tmp_path / "in/bad.csv").write_text("product,date,weight\nbeef,never,2\n")
    (tmp_path / "in/none.csv").write_text("a,b\n")
    files = flows.read_files(spark, str(tmp_path / "in"))
    flows.intake(files, "2011-12-31 00:00:00", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {n: [r["upload"] for r in read_batches(spark, str(tmp_path / "out"), n, schema).collect()] for n, schema in flows.INTAKE.items()}
    assert got == {"refused": ["none.csv"], "rejected": ["bad.csv"], "accepted": ["good.csv"]}
