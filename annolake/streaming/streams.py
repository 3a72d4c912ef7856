"""Pipelines on streams: the steps work on a document's own array of spans, so the same plan runs there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators import output
from annolake.plans import pipeline


def redacted(docs: DataFrame, config: dict) -> DataFrame:
    """A stream, or table, of documents run through a pipeline: doc_id, output_text, span_count."""
    return output.rendered(pipeline.run(docs, config)).select("doc_id", "output_text", F.size("spans").alias("span_count"))


def once(docs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Documents that come again within the delay are let through once."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["doc_id"])


def to_table(docs: DataFrame, path: str, checkpoint: str, log: str | None = None, name: str = "stream"):
    """Starts a query that appends each batch to ``path`` and a row about it to ``log``."""

    def write(batch: DataFrame, number: int) -> None:
        # the batch's number makes a rerun of it overwrite its own folder
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if log:
            row = batch.agg(F.lit(f"{name}-{number}").alias("id"), F.current_timestamp().cast("timestamp_ntz").alias("timestamp"), F.lit("stream").alias("command"), F.lit(name).alias("pipeline_name"), F.count("*").alias("doc_count"), F.sum("span_count").cast("long").alias("span_count"), F.lit("stream").alias("source"))
            row.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_runs(log: DataFrame, delay: str = "2 hours") -> DataFrame:
    """An extension: runs by hour and command behind a watermark."""
    return log.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 hour").alias("w"), "command").agg(F.count("*").alias("runs")).select(F.col("w.start").alias("hour"), "command", "runs")
