"""Extra columns with names that the operators use inside come through unchanged."""

from pyspark.sql import functions as F

from larder.llm import mixing, near_dedup, quality

EXTRA = ["score", "whole_text", "cell", "probability", "node", "Topic", "weight", "h"]


def test_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = docs.select("*", *[F.lit(7).alias(c) for c in EXTRA])
    for kept in (quality.accepted(docs, labels), mixing.sample(docs), near_dedup.deduplicate(docs)):
        assert kept.columns == docs.columns
        assert kept.where(" or ".join(f"`{c}` <> 7" for c in EXTRA)).count() == 0
