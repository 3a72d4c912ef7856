"""Writers of annotated corpora (SURVEY B). Each writes with Spark's own file sinks, in parallel."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from annolake.operators import analytics, tagging
from annolake.operators.corpus import unique_names
from annolake.operators.output import overlapping, with_surrogates
from annolake.operators.resolve import drop_overlapping
from annolake.schema import checked
from annolake.sources.scratch import discard, mounted_or_none, publish


def _record(docs: DataFrame) -> Column:
    meta = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("metadata")).alias("document"), "spans"))


def jsonl(docs: DataFrame, path: str) -> None:
    """Annotated documents, one a line."""
    docs.select(_record(docs).alias("value")).write.text(path)


def stem(doc_id: Column) -> Column:
    """Characters other than words, - and . as _, none of ._ at the ends, 200 at most."""
    safe = F.regexp_replace(F.regexp_replace(doc_id.cast("string"), r"(?U)[^\w\-.]", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(safe == "", "doc").otherwise(safe), 1, 200)


def _ann() -> Column:
    """The lines of a document's annotations."""
    return F.transform("spans", lambda s, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit("\t"), s["label"], F.lit(" "), s["start"].cast("string"), F.lit(" "), s["end"].cast("string"), F.lit("\t"), F.translate(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), "\n", " ")))


def brat(docs: DataFrame, path: str, split: str | None = None) -> None:
    """A folder for each stem (and split) with text.txt and spans.ann written as part files: the layout
    that partitioned writers give, which keeps the driver out of the data. In a mounted folder tasks write these files
    themselves: Spark's writer takes some 9 ms for each, and the driver then renames each document's folder."""
    base = docs.withColumn("__base", stem(F.col("doc_id")))
    named = unique_names(base, "__base", ["doc_id"], "stem")
    parts = [split, "stem"] if split else ["stem"]
    if split or not (at := mounted_or_none(path)):
        put = lambda value, to: named.select(*parts, value.alias("value")).write.partitionBy(*parts).option("lineSep", "\n").text(to)
        put(F.col("text"), f"{path}/txt")
        put(F.array_join(_ann(), "\n"), f"{path}/ann")
        return
    for kind in ("txt", "ann"):
        if os.path.exists(os.path.join(at, kind)):
            raise ValueError(f"{path}/{kind} is there already")

    def put(part):
        for r in part:
            for kind, value in (("txt", r["text"]), ("ann", r["ann"])):
                folder = os.path.join(at, kind, f"stem={r['stem']}")
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, "part-0.txt"), "w", encoding="utf-8", newline="") as f:
                    f.write(value + "\n")

    named.select("stem", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.array_join(_ann(), "\n"), F.lit("")).alias("ann")).foreachPartition(put)
    for kind in ("txt", "ann"):
        os.makedirs(os.path.join(at, kind), exist_ok=True)


def brat_files(docs: DataFrame, path: str, split: str | None = None) -> None:
    """<stem>.txt and <stem>.ann as other tools read them, in a folder that all executors mount. Each task
    writes its own documents; a task that runs again writes the same files again."""
    base = docs.withColumn("__base", stem(F.col("doc_id")))
    line = F.transform(_ann(), lambda x: F.concat(x, F.lit("\n")))
    rows = unique_names(base, "__base", ["doc_id"], "stem").select(F.col(split).alias("split") if split else F.lit("").alias("split"), "stem", F.coalesce("text", F.lit("")).alias("text"), F.array_join(line, "").alias("ann"))

    def put(part):
        for r in part:
            at = os.path.join(path, r["split"] or "")
            os.makedirs(at, exist_ok=True)
            for ext, value in (("txt", r["text"]), ("ann", r["ann"])):
                with open(os.path.join(at, f"{r['stem']}.{ext}"), "w", encoding="utf-8", newline="") as f:
                    f.write(value)

    rows.foreachPartition(put)


def export(docs: DataFrame, path: str, kind: str) -> None:
    """doc_id, original_text, output_text, spans_json, span_count as text, json, jsonl, csv or parquet."""
    t = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("original_text"), "output_text", F.to_json("spans").alias("spans_json"), F.size("spans").alias("span_count"))
    if kind == "text":
        t.select("output_text").write.text(path)
    elif kind in ("json", "jsonl"):
        t.write.json(path)
    elif kind == "csv":
        t.write.csv(path, header=True, quote='"', escape='"')
    elif kind == "parquet":
        t.write.parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def conll_lines(docs: DataFrame) -> DataFrame:
    """A document as lines of token and tag, between a -DOCSTART- line and blank lines."""
    t = tagging.tagged(docs, ["doc_id"])
    pairs = F.transform(F.arrays_zip("tokens", "tags"), lambda x: F.concat(x["tokens"]["text"], F.lit(" "), x["tags"]))
    return t.select("doc_id", F.concat(F.lit("-DOCSTART- -X- O O\n\n"), F.array_join(pairs, "\n"), F.lit("\n")).alias("value"))


def conll(docs: DataFrame, path: str) -> None:
    conll_lines(docs).select("value").write.text(path)


def token_classification(docs: DataFrame, path: str) -> None:
    """Id, tokens and ner_tags, one document a line."""
    t = tagging.tagged(docs, ["doc_id"])
    t.select(F.col("doc_id").cast("string").alias("id"), F.transform("tokens", lambda x: x["text"]).alias("tokens"), F.col("tags").alias("ner_tags")).write.json(path)


def non_overlapping(docs: DataFrame) -> DataFrame:
    """The spans that a format without overlaps can hold, from left to right."""
    return docs.withColumn("spans", drop_overlapping(F.col("spans")))


def surrogate_jsonl(docs: DataFrame, path: str, seed: int = 42) -> None:
    """Texts with surrogates and their spans; any overlap fails the whole export.

    One pass writes to a folder beside ``path`` and counts the documents with overlapping spans on its way; the folder
    gets its name only if there were none, else it is deleted.
    """
    seen, spark = Observation(), docs.sparkSession
    bad = overlapping(F.col("spans"))
    watched = docs.observe(seen, F.count(F.when(bad, 1)).alias("n"), F.min(F.when(bad, F.col("doc_id").cast("string"))).alias("first"), F.max(F.when(bad, F.col("doc_id").cast("string"))).alias("last"))
    out = with_surrogates(watched, seed, on_overlap="drop")
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    jsonl(out.withColumn("text", F.col("output_text")).withColumn("spans", F.col("output_spans")), staged)
    found = seen.get
    if found["n"]:
        discard(spark, staged)
        raise ValueError(f"overlapping spans in {found['n']} documents, {found['first']} and {found['last']} among them")
    publish(spark, staged, path)


def manifest(docs: DataFrame, path: str) -> None:
    """The corpus's statistics as a one-row table."""
    analytics.bundle(docs).write.mode("overwrite").json(path)


def register(docs: DataFrame, root: str, name: str) -> None:
    """A new dataset with its manifest; the name must be plain, new, and the corpus valid and not empty."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", name):
        raise ValueError(f"not a dataset name: {name!r}")
    docs = checked(docs)
    if docs.isEmpty():
        raise ValueError("the corpus is empty")
    jsonl(docs, f"{root}/{name}/corpus")
    manifest(docs, f"{root}/{name}/manifest")


def update_document(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``changed`` in place of those of the same doc_id, as a table. What is stored as
    buckets.BucketedCorpus is changed in place, with versions."""
    return checked(docs.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed.select(docs.columns)))


def metrics_json(df: DataFrame) -> DataFrame:
    """Metric rows as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
