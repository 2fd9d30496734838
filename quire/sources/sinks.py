"""Sinks: JSON by page, raw backups, baselines and markers of what is up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.values import content_marker


def write_json(df: DataFrame, path: str, by: str = "page_id", mode: str = "overwrite") -> None:
    """One folder a page, JSON lines."""
    df.write.mode(mode).partitionBy(by).json(path)


def raw_backup(df: DataFrame, path: str) -> None:
    """Keep the first raw copy: written once, later calls change nothing."""
    df.write.mode("ignore").parquet(path)


def source_markers(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(name).alias("name"), content_marker(F.col(content)).alias("marker"))


def changed_sources(now: DataFrame, before: DataFrame) -> DataFrame:
    """Names whose marker is new or differs from the last run's."""
    return now.join(before.select("name", "marker"), ["name", "marker"], "left_anti")


def upsert(spark: SparkSession, scores: DataFrame, path: str, key: str = "fixture") -> None:
    """Baselines by key: rows of ``scores`` replace those of their key, others stay.

    Written as one folder a key, of which only those in ``scores`` are replaced.
    """
    (scores.withColumn("__key", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__key").parquet(path))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("__key")
