"""Weighted rendezvous sharding with gapless slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.shared import documents, unit_hash

BUCKETS = 4096
"""Parts of a shard that are numbered apart; fixed, so that slots do not depend on the cluster."""


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest weighted rank for ``key``.

    Each shard draws -ln(u) / weight from a hash of (key, shard); the smallest
    draw wins. A further shard changes no other draw, so it takes rows only into
    itself. Equal draws go to the lower shard.
    """
    draws = [
        F.struct((-F.ln(unit_hash(key, F.lit(str(s)))) / F.lit(float(w))).alias("draw"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*draws))["shard"]


def shard(
    docs: DataFrame,
    weights: list[float],
    grown: list[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every row's shard by its key, and its slot in that shard.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 1),
    text_crc32, law ('key'), shard, slot and grown_shard (the shard under
    ``grown``, by default one more shard of mean weight). Null keys share one
    key. Repeated rows go to the same shard and get slots of their own. An empty
    table gives an empty result; other columns are ignored.

    Slots: rows are numbered within (shard, bucket), a bucket being a hash of key
    and text so that rows without a key are spread, and the rows of the buckets
    before are added, so no task holds a whole shard.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    bucket = F.pmod(F.crc32(F.concat_ws(":", key, F.crc32(F.coalesce(F.col(text_col), F.lit(""))))), F.lit(buckets)).cast("int")
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    counts = (
        docs.select(rendezvous(key, weights).alias("shard"), bucket.alias("bucket"))
        .groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shard and bucket: its size is fixed by the two counts, not by the data.
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(order))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - 1).alias("slot"),
            "grown_shard",
        )
    )


SHARDS = [1.0] * 8


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), SHARDS)


QUERIES = {"op10_rendezvous_sharding": op10_rendezvous_sharding}
ORACLE_SQL: dict[str, str] = {}
