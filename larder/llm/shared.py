"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "6m"
BROADCAST_BYTES = 48 << 20
"""Tables are broadcast up to so many counted bytes, else shuffled."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the session names none, a temporary folder, but only if driver and
    executors are one process; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/larder-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 32
    return F.lit(8)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the counted bytes of ``df`` allow a broadcast; ``df`` should be settled, as it is read to count."""
    if df.limit(most // 16 + 1).count() > most // 16:
        return False
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint where its counted bytes allow it."""
    return F.broadcast(df) if is_small(df, most) else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores ahead until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not
    everything before this point. While it is written, Python workers get batches
    of at most BATCH_BYTES, so that neither side of the exchange holds many rows.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/larder/{name}-{uuid.uuid4().hex}"
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, BATCH_BYTES)
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(limit, before)
    return spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from md5 of the parts, joined by ':'; the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
