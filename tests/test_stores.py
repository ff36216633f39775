"""Sources and sinks: twins of their queries, and what is seen after failures and replays."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larder.plans import stores
from larder.sources import blobs, sinks


@pytest.mark.parametrize("name", sorted(stores.QUERIES))
def test_twin(same, name):
    same(stores.QUERIES[name], stores.ORACLE_SQL[name])


def test_listing(spark, tmp_path):
    for key in ("a/1/x", "a/1/deep/er/y", "a/10/z", "a/b", "top"):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_text(key)
    keys = lambda df: sorted(r.key for r in df.collect())
    at = str(tmp_path)
    assert keys(blobs.list_objects(spark, at)) == ["a/1/deep/er/y", "a/1/x", "a/10/z", "a/b", "top"]
    assert keys(blobs.list_objects(spark, at, "a/1/")) == ["a/1/deep/er/y", "a/1/x"]
    assert keys(blobs.list_objects(spark, at, "a/1")) == ["a/1/deep/er/y", "a/1/x", "a/10/z"]
    assert keys(blobs.list_objects(spark, at, "t")) == ["top"] and keys(blobs.list_objects(spark, at, "none/")) == []
    assert keys(blobs.list_objects(spark, f"{at}/missing")) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert keys(blobs.list_objects(spark, at).where("key LIKE 'a/1/%' AND size > 3")) == ["a/1/deep/er/y", "a/1/x"]
        assert keys(blobs.list_objects(spark, at).where("key = 'a/b'")) == ["a/b"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = blobs.FilteringReader(at, "a/1")
    assert not list(reader.pushFilters([blobs.StringStartsWith(("key",), "a/1/d")])) and reader.prefix == "a/1/d"


def test_listing_in_pages_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "PAGE", 7)
    monkeypatch.setattr(blobs, "LEAST_PARTS", 5)
    for i in range(90):
        (tmp_path / f"{i % 9}/{i % 4}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{i % 9}/{i % 4}/{i}").write_text("x" * i)
    assert len(blobs.ObjectReader(str(tmp_path), "").partitions()) >= 5
    assert sorted((r.key, r.size) for r in blobs.list_objects(spark, str(tmp_path)).collect()) == sorted((f"{i % 9}/{i % 4}/{i}", i) for i in range(90))


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"\x00\xff")
    (tmp_path / "large").write_bytes(b"x" * 100)
    (tmp_path / "none").write_bytes(b"")
    found = {r.key: (r.content and bytes(r.content), r.size) for r in blobs.scan_uploads(spark, str(tmp_path), most=50).collect()}
    assert found == {"small": (b"\x00\xff", 2), "large": (None, 100), "none": (b"", 0)}


def test_documents_by_lane(spark, tmp_path):
    texts = {"a": '{"x": 1}', "b": '"s": 1', "c": "", "d": "null", "e": "[1], [2]", "f": "{} {}", "g": '1, "y": 2', "h": ' [1, "é"]\n', "i": '{"x": 1'}
    for k, t in texts.items():
        (tmp_path / k / "sub").mkdir(parents=True)
        (tmp_path / k / "sub/run.json").write_text(t)
        (tmp_path / k / "other.json").write_text("{}")
    (tmp_path / "run.json").write_bytes(b'"\xff"')
    parsed, broken = blobs.scan_documents(spark, str(tmp_path), "run.json")
    assert sorted(r.folder for r in parsed.collect()) == ["a/sub", "d/sub", "h/sub"]
    assert sorted((r.folder, r.message) for r in broken.collect()) == sorted((f, "run.json: not valid JSON") for f in ["", *(f"{k}/sub" for k in "bcefgi")])
    _, large = blobs.scan_documents(spark, str(tmp_path), "run.json", most=7)
    assert {r.folder: r.message for r in large.collect()}["a/sub"] == "run.json: too large"


def _accepted(spark, n):
    rows = spark.range(n).select(F.col("id").alias("upload"), F.explode(F.array(F.lit(3), F.lit(2))).alias("line"))
    return rows.select("upload", "line", F.concat(F.lit('say "x", '), F.col("line")).alias("product"), F.lit("2011-01-05").alias("iso"), F.lit(2.5).alias("weight"))


def test_many_uploads_few_containers(spark, tmp_path):
    at = str(tmp_path / "out")
    sinks.write_normalized(_accepted(spark, 10_000), at)
    assert len(list((tmp_path / "out/data").iterdir())) <= 20
    index = sinks.normalized_index(spark, at)
    assert index.count() == index.select("upload").distinct().count() == 10_000
    want = 'product,date,weight\n"say ""x"", 2",2011-01-05,2.5\n"say ""x"", 3",2011-01-05,2.5\n'
    assert [r.text for r in sinks.read_normalized(index.where("upload IN (7, 9999)"), at).collect()] == [want, want]


def test_failed_containers_leave_nothing(spark, tmp_path):
    at = str(tmp_path / "out")
    bad = _accepted(spark, 100).withColumn("product", F.when(F.col("upload") == 57, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("product")))
    with pytest.raises(PySparkException):
        sinks.write_normalized(bad, at)
    assert sinks.normalized_index(spark, at).count() == 0
    sinks.write_normalized(_accepted(spark, 100), at)
    assert sinks.normalized_index(spark, at).count() == 100


def test_batch_killed_between_tables_shows_nothing(spark, tmp_path):
    at = str(tmp_path)
    good, bad = spark.range(3), spark.range(3).withColumn("id", F.raise_error(F.lit("stop")).cast("long"))
    sinks.commit_batch({"a": good, "b": good}, at, 0)
    with pytest.raises(PySparkException):
        sinks.commit_batch({"a": good, "b": bad}, at, 1)
    seen = lambda t: sorted(map(tuple, sinks.read_batches(spark, at, t, "id long").collect()))
    assert seen("a") == seen("b") == [(0, 0), (1, 0), (2, 0)]
    sinks.commit_batch({"a": good, "b": good.where("id = 0")}, at, 1)
    assert seen("b") == [(0, 0), (0, 1), (1, 0), (2, 0)] and len(seen("a")) == 6
    assert seen("none") == []


def test_outbox_replays_add_nothing(spark, tmp_path):
    rows = [(i, "analysis-failed", f"{i}@x", "s", "b") for i in range(6)]
    for k in range(3):
        spark.createDataFrame([*rows[2 * k : 2 * k + 2], rows[0]], sinks.OUTBOX).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sinks.OUTBOX).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), tmp_path / "checkpoint"
    sinks.send(stream, out, str(checkpoint)).awaitTermination(120)
    first = sorted(map(tuple, sinks.read_outbox(spark, out).collect()))
    assert first == rows
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    files = len(list((tmp_path / "out/data").iterdir()))
    sinks.send(stream, out, str(checkpoint)).awaitTermination(120)
    assert sorted(map(tuple, sinks.read_outbox(spark, out).collect())) == rows
    assert len(list((tmp_path / "out/data").iterdir())) == files
