"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def builder(app: str = "marlstone") -> SparkSession.Builder:
    """UTC, adaptive plans, and column statistics pushed into Parquet scans."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
    )


def local(cores: int | None = None, memory: str = "8g") -> SparkSession:
    cores = cores or os.cpu_count() or 1
    conf = {"spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.memory": memory, "spark.ui.showConsoleProgress": "false"}
    return builder().master(f"local[{cores}]").config(map=conf).getOrCreate()


def metadata_reads(spark: SparkSession, *path: str):
    """A Parquet table, of one path or several, read through the source that answers bare COUNT, MIN and MAX from footers."""
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(*path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
