"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """UTC and adaptive execution; everything else stays with the cluster."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()
