"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, source mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm import decontaminate, language_id, line_dedup, minhash, mixing
from annolake.llm.common import shared_dir


#: Bytes of one Arrow batch. A task holds a batch in the JVM and in Python, on the way there and back, and its Python worker
#: keeps what its largest batch took; by Spark's default 10,000 whole texts are one batch.
BATCH_BYTES = 4_000_000
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark) -> None:
    """From now on the session's Arrow batches hold about BATCH_BYTES at most."""
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the operator finds in no language (``und``): null text, or text without a letter. Where
    no model could be learnt, ``und`` says nothing of a document, and those with letters stay."""
    in_small_batches(spark)
    model = language_id.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.identify(docs, model).where("lang_pred != 'und'").select(docs.columns)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated lines; every document stays, n_chars counts its new text."""
    in_small_batches(spark)
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; null doc_ids all stay."""
    in_small_batches(spark)
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of benchmark words go."""
    in_small_batches(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, bench).where("n_hit = 0").select(docs.columns)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken (repeats counted)."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: Language ID and near-duplicate removal have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next. The
    session's size of Arrow batches is put back at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_CONF)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
    finally:
        spark.conf.set(BATCH_CONF, before)
    return docs
