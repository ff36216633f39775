"""Sinks whose output appears whole or not at all.

Tasks write files that nobody reads yet; the driver then writes one small
manifest, and readers go by manifests only. What a failed task, a lost executor
or a killed driver leaves behind is never seen.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from larder.operators.submission import output_line
from larder.sources.blobs import located
from larder.sources.store import settle

CONTAINER_BYTES = 128 << 20
"""About how many bytes of normalized files a container holds."""
HEADER = b"product,date,weight\n"
INDEX = pa.schema([("upload", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_ROWS = 4096


@dataclass
class Written(WriterCommitMessage):
    """The files that a task wrote; only their names go through the driver."""

    files: list[str] = field(default_factory=list)


def _put_manifest(store: fs.FileSystem, folder: str, name: str, body: dict) -> bool:
    """Write a manifest under its name at once; False if one of that name is there already."""
    to = posixpath.join(folder, f"{name}.json")
    if store.get_file_info(to).type == fs.FileType.File:
        return False
    store.create_dir(folder, recursive=True)
    part = posixpath.join(folder, f".{uuid.uuid4().hex}")
    with store.open_output_stream(part) as out:
        out.write(json.dumps(body).encode())
    store.move(part, to)
    return True


def _manifests(store: fs.FileSystem, folder: str) -> dict[str, dict]:
    found = {}
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        name = posixpath.basename(f.path)
        if name.endswith(".json") and not name.startswith("."):
            with store.open_input_stream(f.path) as file:
                found[name.removesuffix(".json")] = json.loads(file.read())
    return found


def _discard(store: fs.FileSystem, base: str, messages: list) -> None:
    for m in messages:
        for f in m.files if m else []:
            if store.get_file_info(posixpath.join(base, f)).type == fs.FileType.File:
                store.delete_file(posixpath.join(base, f))


class ContainerWriter(DataSourceArrowWriter):
    """Rows of upload, line, text, each upload's together and in order, to a container file and an index beside it."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = located(self.path)
        name = f"data/{self.run}-{uuid.uuid4().hex}"
        out = index = now = None
        start, entries = 0, []

        def close_upload() -> None:
            entries.append({"upload": now, "file": f"{name}.csv", "offset": start, "length": out.tell() - start})
            if len(entries) == INDEX_ROWS:
                index.write_table(pa.Table.from_pylist(entries, schema=INDEX))
                entries.clear()

        for batch in batches:
            for upload, text in zip(batch.column("upload").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None:
                    store.create_dir(posixpath.join(base, "data"), recursive=True)
                    out = store.open_output_stream(posixpath.join(base, f"{name}.csv"))
                    index = pq.ParquetWriter(posixpath.join(base, f"{name}.parquet"), INDEX, filesystem=store)
                if upload != now or out.tell() == 0:
                    if out.tell():
                        close_upload()
                    now, start = upload, out.tell()
                    out.write(HEADER)
                out.write(text.encode() + b"\n")
        if out is None:
            return Written()
        close_upload()
        out.close()
        if entries:
            index.write_table(pa.Table.from_pylist(entries, schema=INDEX))
        index.close()
        return Written([f"{name}.csv", f"{name}.parquet"])

    def commit(self, messages: list) -> None:
        store, base = located(self.path)
        _put_manifest(store, posixpath.join(base, "manifests"), self.run, {"index": [f for m in messages if m for f in m.files if f.endswith(".parquet")]})

    def abort(self, messages: list) -> None:
        store, base = located(self.path)
        _discard(store, base, messages)


class Containers(DataSource):
    """Format ``larder_containers``: writes rows of upload, line, text."""

    @classmethod
    def name(cls) -> str:
        return "larder_containers"

    def schema(self) -> str:
        return "upload long, line int, text string"

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(self.options["path"])


def write_normalized(accepted: DataFrame, path: str) -> None:
    """The normalized file of every upload of ``accepted`` (upload, line, product, iso, weight), header first.

    Files are packed into containers of about CONTAINER_BYTES with an index
    (upload, file, offset, length). A write that fails leaves nothing to see;
    writes add up, and of an upload written twice the reader sees both.
    """
    spark = accepted.sparkSession
    spark.dataSource.register(Containers)
    lines = settle(accepted.select("upload", "line", output_line(F.col("product"), F.col("iso"), F.col("weight")).alias("text")), "normalized-lines")
    total = lines.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    packed = lines.repartition(-(-total // CONTAINER_BYTES) or 1, "upload").sortWithinPartitions("upload", "line")
    packed.write.format("larder_containers").option("path", path).mode("append").save()


def normalized_index(spark: SparkSession, path: str) -> DataFrame:
    """upload, file, offset, length of the normalized files that were written whole."""
    store, base = located(path)
    files = [f"{path.rstrip('/')}/{f}" for m in _manifests(store, posixpath.join(base, "manifests")).values() for f in m["index"]]
    schema = "upload long, file string, offset long, length long"
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read_normalized(index: DataFrame, path: str) -> DataFrame:
    """upload, text of the rows of an index; each file is read by its range only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out, name, file = [], None, None
                for r in sorted(batch.slice(at, 256).to_pylist(), key=lambda r: (r["file"], r["offset"])):
                    if r["file"] != name:
                        name, file = r["file"], store.open_input_file(posixpath.join(base, r["file"]))
                    out.append({"upload": r["upload"], "text": file.read_at(r["length"], r["offset"]).decode()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("upload", pa.int64()), ("text", pa.string())]))

    return index.mapInArrow(read, "upload long, text string")


def commit_batch(tables: dict[str, DataFrame], out: str, number: int) -> None:
    """The tables of one batch, made visible together; running a batch again replaces it."""
    spark = next(iter(tables.values())).sparkSession
    run, places = uuid.uuid4().hex, []
    for name, df in tables.items():
        at = f"{out.rstrip('/')}/tables/{name}/{number}-{run}"
        df.write.parquet(at)
        places.append((name, at, df.schema.json()))
    spark.createDataFrame(places, "table string, path string, schema string").coalesce(1).write.mode("overwrite").json(f"{out.rstrip('/')}/batches/batch={number}")


def read_batches(spark: SparkSession, out: str, table: str, schema: StructType | str) -> DataFrame:
    """One table over all committed batches, with the column batch; empty if there is none.

    ``schema`` is what the table has, for the time before its first batch.
    """
    files = f"{out.rstrip('/')}/batches/*/part-*.json"
    store, base = located(out)
    if not store.get_file_info(fs.FileSelector(posixpath.join(base, "batches"), allow_not_found=True)):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    known = spark.read.schema("table string, path string, schema string").json(files).where(F.col("table") == table).collect()
    parts = [r["path"] for r in known]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    rows = spark.read.schema(StructType.fromJson(json.loads(known[0]["schema"]))).parquet(*parts)
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)-[0-9a-f]{32}/[^/]*$", 1).cast("long"))


class OutboxWriter(DataSourceStreamWriter):
    """Rows of a batch to files; a batch that was committed before adds nothing."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = located(self.path)
        name, out, held = f"data/{uuid.uuid4().hex}.parquet", None, []

        def flush() -> None:
            out.write_table(pa.Table.from_pylist(held, schema=MESSAGES))
            held.clear()

        for row in rows:
            if out is None:
                store.create_dir(posixpath.join(base, "data"), recursive=True)
                out = pq.ParquetWriter(posixpath.join(base, name), MESSAGES, filesystem=store)
            held.append(row.asDict())
            if len(held) == INDEX_ROWS:
                flush()
        if out is None:
            return Written()
        if held:
            flush()
        out.close()
        return Written([name])

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        store, base = located(self.path)
        if not _put_manifest(store, posixpath.join(base, "batches"), str(batchId), {"files": [f for m in messages if m for f in m.files]}):
            _discard(store, base, messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        store, base = located(self.path)
        _discard(store, base, messages)


_FIELDS = ["kind", "recipient", "subject", "body"]
MESSAGES = pa.schema([("attempt_id", pa.int64()), *[(c, pa.string()) for c in _FIELDS]])
OUTBOX = "attempt_id long, kind string, recipient string, subject string, body string"


class Outbox(DataSource):
    """Format ``larder_outbox``: a stream of attempt_id, kind, recipient, subject, body."""

    @classmethod
    def name(cls) -> str:
        return "larder_outbox"

    def schema(self) -> str:
        return OUTBOX

    def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(self.options["path"])


def send(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of messages to the outbox at ``path``."""
    messages.sparkSession.dataSource.register(Outbox)
    out = messages.select("attempt_id", *_FIELDS).writeStream.format("larder_outbox").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    """One row for each attempt and kind, from the first batch that has it (ties: by body)."""
    store, base = located(path)
    found = _manifests(store, posixpath.join(base, "batches"))
    files = [(f"{path.rstrip('/')}/{f}", int(batch)) for batch, m in found.items() for f in m["files"]]
    if not files:
        return spark.createDataFrame([], OUTBOX)
    rows = spark.read.schema(OUTBOX).parquet(*[f for f, _ in files]).withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    batches = spark.createDataFrame([(posixpath.basename(f), b) for f, b in files], "name string, batch long")
    first = Window.partitionBy("attempt_id", "kind").orderBy("batch", "recipient", "subject", "body")
    return rows.join(batches, "name").withColumn("i", F.row_number().over(first)).where("i = 1").select("attempt_id", *_FIELDS)
