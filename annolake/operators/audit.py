"""The append-only log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators import paging

LOG = "id string, timestamp timestamp_ntz, command string, pipeline_name string, pipeline_config string, dataset_source string, doc_count long, error_count long, span_count long, duration_seconds double, metrics string, source string"


def append(log: DataFrame, path: str) -> None:
    """B13."""
    log.write.mode("append").parquet(path)


def select(log: DataFrame, pipeline: str | None = None, source: str | None = None, command: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows by exact names and from, until a time."""
    for column, value in (("pipeline_name", pipeline), ("source", source), ("command", command)):
        log = log.where(F.col(column) == value) if value is not None else log
    log = log.where(F.col("timestamp") >= F.lit(first).cast("timestamp_ntz")) if first else log
    return log.where(F.col("timestamp") <= F.lit(last).cast("timestamp_ntz")) if last else log


def page(log: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first, one page, of which only its range of times is read."""
    return paging.page(log, F.col("timestamp"), offset, limit, [F.col("id")], descending=True)


def find(log: DataFrame, prefix: str) -> DataFrame:
    """The newest row whose id begins so."""
    return log.where(F.startswith("id", F.lit(prefix))).orderBy(F.desc("timestamp"), "id").limit(1)


def totals(log: DataFrame) -> DataFrame:
    """Runs, mean duration, spans."""
    return log.agg(F.count("*").alias("runs"), F.avg("duration_seconds").alias("avg_duration"), F.sum("span_count").alias("spans"))


def top_pipelines(log: DataFrame, n: int = 10) -> DataFrame:
    """Pipelines by runs, those first seen earlier before others alike."""
    return log.groupBy("pipeline_name").agg(F.count("*").alias("runs"), F.min("timestamp").alias("first_seen")).orderBy(F.desc("runs"), "first_seen", "pipeline_name").limit(n)


def by_source(log: DataFrame) -> DataFrame:
    return log.groupBy("source").agg(F.count("*").alias("runs"))


def hourly(log: DataFrame) -> DataFrame:
    """An extension: runs by hour, as a stream rolls them up behind a watermark."""
    return log.groupBy(F.window("timestamp", "1 hour").alias("w"), "command").agg(F.count("*").alias("runs")).select(F.col("w.start").alias("hour"), "command", "runs")
