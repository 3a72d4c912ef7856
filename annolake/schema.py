"""The two relations: documents with an array of spans (nested form), and one row for each span (flat form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,confidence:double,source:string>"
SPANS = f"array<{SPAN}>"
DOCUMENT = f"doc_id string, text string, metadata map<string,string>, spans {SPANS}"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start, end, label, confidence=None, source=None) -> Column:
    """A span of code points [start, end); null confidence means that of a deterministic match."""
    return F.struct(F.lit(start).cast("int").alias("start") if not isinstance(start, Column) else start.cast("int").alias("start"), (end if isinstance(end, Column) else F.lit(end)).cast("int").alias("end"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), (source if isinstance(source, Column) else F.lit(source)).cast("string").alias("source"))


def certain(s: Column) -> Column:
    """A span's confidence, 1 where there is none."""
    return F.coalesce(s["confidence"], F.lit(1.0))


def documents(df: DataFrame) -> DataFrame:
    """A table of texts as documents without spans."""
    return df.withColumn("spans", no_spans()) if "spans" not in df.columns else df


def exploded(docs: DataFrame, keep: list[str], items: Column, place: str, item: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and a row for each of ``items``, with its place. The outer form, as for the plain one
    Spark filters on the array's size first and so computes what makes the array a second time."""
    return docs.select(*keep, F.posexplode_outer(items).alias(place, item)).where(F.col(place).isNotNull())


def flat(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """(doc_id, span_ord, start, end, label, confidence, source): one row for each span, in list order."""
    return exploded(docs, ["doc_id"], F.col(spans) if isinstance(spans, str) else spans, "span_ord", "s").select("doc_id", "span_ord", "s.*")


def nested(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with flat ``spans`` gathered by doc_id in order of span_ord; documents without spans get none."""
    inner = F.struct("span_ord", F.struct("start", "end", "label", "confidence", "source").alias("s"))
    by_doc = spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["s"]).alias("spans"))
    return docs.drop("spans").join(by_doc, "doc_id", "left").withColumn("spans", F.coalesce("spans", no_spans()))


def invalid_spans(docs: DataFrame) -> DataFrame:
    """Spans that break 0 <= start < end <= length of the text."""
    s = docs.select("doc_id", F.length("text").alias("n"), F.explode("spans").alias("s"))
    return s.where("s.start < 0 OR s.end <= s.start OR s.end > n").select("doc_id", "s.*")


def outside(s: Column) -> Column:
    """Whether a span breaks 0 <= start < end <= length of the column ``text``."""
    return (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length("text"))


def aside(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that every operator can take, and (doc_id, message) of the others: those without a text, and those with
    a span outside it."""
    message = F.when(F.col("text").isNull(), "no text").when(F.exists("spans", outside), "a span exceeds the text")
    d = docs.withColumn("__message", message)
    return d.where("__message IS NULL").drop("__message"), d.where("__message IS NOT NULL").select("doc_id", F.col("__message").alias("message"))


def checked(docs: DataFrame) -> DataFrame:
    """``docs``, failing when it is run if a span breaks 0 <= start < end <= length of its text."""
    bad = F.exists("spans", outside)
    message = F.concat(F.lit("a span exceeds the text of document "), F.col("doc_id").cast("string"))
    return docs.withColumn("spans", F.when(bad, F.raise_error(message).cast(SPANS)).otherwise(F.col("spans")))
