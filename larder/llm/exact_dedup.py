"""Exact duplicates by sorting content.

Rows are dealt by sampled splitters over their normalised text, sorted within
each partition, and compared in full with their neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.shared import ascii_lower, documents, partitions, settle

PREFIX = 24
"""Characters of the text in the splitters; a 64-bit hash of the text orders rows beyond it."""


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after lower-casing A-Z. A null text counts as empty. ``keep``
    names the identifier that stays, 'smallest' or 'largest'. Null identifiers
    never win against others; a group of nulls only has a null keep_id and all its
    rows stay. Rows that repeat an identifier and its text share one decision.
    An empty table gives an empty result; other columns are ignored.

    The sort key is a prefix of the text, then a hash of it, then the text itself:
    equals stand next to each other, and the splitters that Spark sends to the
    driver stay short. Texts with more than half a partition's share of rows are
    dealt on under a salt; their parts, at most a few for each partition, are
    joined again at the end.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    spark = docs.sparkSession
    parts = partitions(spark)
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    share = max(2, docs.count() // (2 * parts))
    # At most 2 * parts hashes can have more rows than this share: the bound of the broadcast.
    hot = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > share)
    hot = hot.select("h", (F.ceil(F.col("n") / share)).cast("int").alias("salts"))
    salted = (
        rows.join(F.broadcast(hot), "h", "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)))
        .withColumn("prefix", F.substring("norm", 1, PREFIX))
    )
    equal = Window.partitionBy("prefix", "h", "salt", "norm")
    compared = (
        salted.repartitionByRange("prefix", "h", "salt")
        .sortWithinPartitions("prefix", "h", "salt", "norm")
        .select(
            "doc_id",
            "salts",
            "salt",
            F.sha2("norm", 256).alias("text_sha256"),
            best("doc_id").over(equal).alias("part_keep"),
            F.count("*").over(equal).alias("part_size"),
        )
    )
    compared = settle(compared, "exact-dedup")
    whole = (
        compared.where(F.col("salts").isNotNull())
        .groupBy("text_sha256", "salt")
        .agg(best("part_keep").alias("part_keep"), F.max("part_size").alias("part_size"))
        .groupBy("text_sha256")
        .agg(best("part_keep").alias("whole_keep"), F.sum("part_size").alias("whole_size"))
    )
    return (
        compared.join(F.broadcast(whole), "text_sha256", "left")
        .withColumn("keep_id", F.when(F.col("whole_size").isNull(), F.col("part_keep")).otherwise(F.col("whole_keep")))
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("whole_size", "part_size").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLE_SQL = {
    "op8_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n"""
}
