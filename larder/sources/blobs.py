"""Objects under a path: listed by key prefix, read in packs of even size, written by key.

Listing and reading go through Arrow's file systems, so a path is any URI that
they know (file, s3, gs, hdfs); a plain path is local.
"""

from __future__ import annotations

import datetime
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from larder.functions import fixed
from larder.sources.store import settle

PAGE = 1000
"""Keys of a listing that are handed to Spark at a time."""
LEAST_PARTS = 32
"""A listing is dealt by key prefixes, from the first level that has so many folders, to so many tasks."""
PACK_BYTES = 64 << 20
"""About how many bytes of files a task reads; an open file counts as OPEN_BYTES at least."""
OPEN_BYTES = 256 << 10
MAX_DOCUMENT_BYTES = 64 << 20
PACKS = ".packs"
"""The folder below a path where small objects lie packed; its own files are no objects."""
PACKED = "key string, content binary, size long, modified timestamp, run string, n long"
LISTED = "key string, size long, modified timestamp"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it, without a slash at its end."""
    store, path = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
    return store, path.rstrip("/")


def _children(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))


@dataclass
class Prefix(InputPartition):
    """A part of a listing: what lies below some folders, or only the files right in them."""

    folders: list[str]
    deep: bool


class ObjectReader(DataSourceReader):
    def __init__(self, path: str, prefix: str):
        self.path, self.prefix = path, prefix

    def _may_hold(self, key: str) -> bool:
        """Whether keys below the folder ``key`` can start with the prefix."""
        return key != PACKS and (f"{key}/".startswith(self.prefix) or self.prefix.startswith(f"{key}/"))

    def partitions(self) -> list[InputPartition]:
        store, base = located(self.path)
        seen: list[str] = []
        level = [posixpath.join(base, posixpath.dirname(self.prefix)) if "/" in self.prefix else base]
        while level and len(level) < LEAST_PARTS:
            below = []
            for folder in level:
                seen.append(folder)
                below += [c.path for c in _children(store, folder) if c.type == fs.FileType.Directory and self._may_hold(c.path[len(base) + 1 :])]
            level = below
        return [Prefix(seen, False), *(Prefix(level[i::LEAST_PARTS], True) for i in range(min(len(level), LEAST_PARTS)))]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        store, base = located(self.path)
        left, page = list(partition.folders), []
        while left:
            for c in sorted(_children(store, left.pop()), key=lambda c: c.path):
                key = c.path[len(base) + 1 :]
                if c.type == fs.FileType.Directory:
                    if partition.deep and self._may_hold(key):
                        left.append(c.path)
                elif key.startswith(self.prefix):
                    page.append({"key": key, "size": c.size, "modified": c.mtime or datetime.datetime.fromtimestamp(0, datetime.timezone.utc)})
                    if len(page) == PAGE:
                        yield _page(page)
                        page = []
        if page:
            yield _page(page)


class FilteringReader(ObjectReader):
    """For sessions that push filters into Python sources; the others refuse a reader that takes any."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A prefix or a whole key narrows what is listed; Spark still applies every filter it knows better."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("key",) and str(f.value).startswith(self.prefix):
                self.prefix = str(f.value)
                yield f
            else:
                yield f


def _page(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]))


@dataclass
class Put(WriterCommitMessage):
    n: int


class ObjectWriter(DataSourceWriter):
    """Writes content under key; a file appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Put:
        store, base = located(self.path)
        made, n = set(), 0
        for row in rows:
            to = posixpath.join(base, row["key"])
            folder = posixpath.dirname(to)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            part = posixpath.join(folder, f".{uuid.uuid4().hex}")
            with store.open_output_stream(part) as out:
                out.write(bytes(row["content"] or b""))
            store.move(part, to)
            n += 1
        return Put(n)


class Objects(DataSource):
    """Format ``larder_objects``: options path, prefix and pushdown; rows of key, size, modified; writes rows of key, content."""

    @classmethod
    def name(cls) -> str:
        return "larder_objects"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> ObjectReader:
        kind = FilteringReader if self.options.get("pushdown") == "true" else ObjectReader
        return kind(self.options["path"], self.options.get("prefix", ""))

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"])


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Key, size, modified of the objects whose key starts with ``prefix``; no file is opened.

    A prefix is a string, not a folder: 'org/1' finds 'org/10/x' too, 'org/1/'
    does not. Tasks list different folders, each a page at a time. A path that does
    not exist lists nothing; keys of files being written start with a dot in their
    name and are listed under it until they are moved. Packed objects are listed
    from their packs, each key once, as it was put last.
    """
    loose, packed = _found(spark, path, prefix)
    return loose if packed is None else loose.select("key", "size", "modified").unionByName(packed.select("key", "size", "modified"))


def _loose(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    spark.dataSource.register(Objects)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("larder_objects").option("path", path).option("prefix", prefix).option("pushdown", pushdown).load()


def _found(spark: SparkSession, path: str, prefix: str) -> tuple[DataFrame, DataFrame | None]:
    """The objects that are files, and the packed ones (PACKED), or None where nothing was ever packed; no key twice."""
    loose = _loose(spark, path, prefix)
    store, base = located(path)
    if store.get_file_info(posixpath.join(base, PACKS)).type != fs.FileType.Directory:
        return loose, None
    packed = spark.read.schema(PACKED).parquet(f"{path.rstrip('/')}/{PACKS}/*").where(F.startswith("key", F.lit(prefix)))
    put = F.struct("modified", "run", "n")
    puts = packed.select("key", put.alias("put")).unionByName(loose.select("key", F.struct("modified", F.lit("").alias("run"), F.lit(0).cast("long").alias("n")).alias("put")))
    again = settle(puts.groupBy("key").agg(F.count("*").alias("times"), F.max("put").alias("last")).where("times > 1").select("key", "last"), "put-again")
    if again.isEmpty():
        return loose, packed

    def newest(df: DataFrame, put: Column) -> DataFrame:
        return df.join(again, "key", "left").where(F.col("last").isNull() | (put == F.col("last"))).select(*df.columns)

    return newest(loose, F.struct("modified", F.lit("").alias("run"), F.lit(0).cast("long").alias("n"))), newest(packed, put)


def pack_objects(objects: DataFrame, path: str) -> None:
    """Rows of key, content as packed objects; a key that is there is replaced.

    For small objects in great number: each file takes a block of disk and an
    entry of its folder, whatever its size; packs take what their bytes do. They are
    listed and scanned with the files; a put that fails leaves nothing to see.
    """
    run, content = uuid.uuid4().hex, F.coalesce("content", F.lit(b""))
    rows = objects.select("key", content.alias("content"), F.octet_length(content).cast("long").alias("size"), F.current_timestamp().alias("modified"), F.lit(run).alias("run"), F.monotonically_increasing_id().alias("n"))
    rows.write.parquet(f"{path.rstrip('/')}/{PACKS}/{run}")


def put_objects(objects: DataFrame, path: str) -> None:
    """Rows of key, content as files; a key that is there is replaced."""
    spark = objects.sparkSession
    spark.dataSource.register(Objects)
    objects.select("key", "content").write.format("larder_objects").option("path", path).mode("append").save()


def scan_uploads(spark: SparkSession, path: str, prefix: str = "", most: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Key, content, size of the files; content is null where a file is larger than ``most``, whose bytes are not read.

    Files are listed first and dealt to tasks by their counted bytes, so a million
    small files make a few thousand tasks. A file that went meanwhile has a null
    content and its listed size.
    """
    return _contents(*_found(spark, path, prefix), path, most)


def _contents(listed: DataFrame, packed: DataFrame | None, path: str, most: int) -> DataFrame:
    """key, content, size of listed files and packed objects."""
    listed = listed.select("key", "size")
    cost = F.when(F.col("size") > most, OPEN_BYTES).otherwise(F.greatest("size", F.lit(OPEN_BYTES)))
    packs = -(-(listed.agg(F.sum(cost)).first()[0] or 0) // PACK_BYTES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(path)
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                content = None
                if r["size"] <= most:
                    try:
                        with store.open_input_stream(posixpath.join(base, r["key"])) as file:
                            content = file.read()
                    except FileNotFoundError:
                        pass
                held.append(r | {"content": content})
                size += r["size"] if content is not None else 0
                if size >= 8 << 20 or len(held) >= PAGE:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    kinds = pa.schema([("key", pa.string()), ("content", pa.binary()), ("size", pa.int64())])
    files = listed.repartition(max(packs, 1), "key").mapInArrow(read, "key string, content binary, size long")
    if packed is None:
        return files
    return files.unionByName(packed.select("key", F.when(F.col("size") <= most, F.col("content")).alias("content"), "size"))


def _whole_json(text: Column) -> Column:
    """The document as VARIANT; null unless the whole text is one JSON value. The parser alone would not see what follows it."""
    as_field, as_item = F.concat(F.lit('{"x":'), text, F.lit("}")), F.concat(F.lit("["), text, F.lit("]"))
    one = (F.size(F.json_object_keys(as_field)) == 1) & (F.json_array_length(as_item) == 1)
    return F.when(one, F.try_variant_get(F.try_parse_json(as_field), "$.x", "variant"))


def scan_documents(spark: SparkSession, path: str, name: str, most: int = MAX_DOCUMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """S3: (parsed: folder, text, v; broken: folder, text, message) of the files called ``name`` anywhere below ``path``.

    ``v`` is the document as VARIANT; a file that is no UTF-8 or no JSON is in the
    second table, with the reason, and one larger than ``most`` too, unread.
    ``folder`` is what stands before the name in the key.
    """
    called = (F.col("key") == name) | F.col("key").endswith(f"/{name}")
    listed, packed = _found(spark, path, "")
    listed, packed = listed.where(called), None if packed is None else packed.where(called)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = _contents(listed, packed, path, most).select(F.regexp_replace("key", "/?[^/]*$", "").alias("folder"), text.alias("text"), F.col("content").isNull().alias("unread"))
    rows = settle(rows.withColumn("v", _whole_json(F.col("text"))), "documents")
    reason = F.when(F.col("unread"), f"{name}: too large").otherwise(f"{name}: not valid JSON")
    return rows.where(F.col("v").isNotNull()).select("folder", "text", "v"), rows.where(F.col("v").isNull()).select("folder", "text", reason.alias("message"))
