"""Corpus profiles. Inputs are documents in nested form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators import paging
from annolake.functions.text import overlap, surface, token_count
from annolake.schema import flat

UNSPLIT = "(none)"
SPLIT_ORDER = ("train", "valid", "test", "dev", "deploy", UNSPLIT)


def split_bucket(split: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(split), F.lit("")), F.lit(UNSPLIT))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, min, max and sample deviation; zeros where there is none. Unrounded: rounding doubles differs
    between engines, so it is left to display."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("n"), *[F.coalesce(f(c), F.lit(0.0)).alias(k) for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))])


def docs_by_span_count(docs: DataFrame, most: int = 20) -> DataFrame:
    """Documents by number of spans, one bucket beyond ``most``."""
    n = F.size("spans")
    return docs.groupBy(F.when(n <= most, n.cast("string")).otherwise(f"{most + 1}+").alias("bucket")).agg(F.count("*").alias("docs"))


def span_lengths(docs: DataFrame) -> DataFrame:
    """Spans by length: 0, 1-10, 11-20, 21-50, 51-100, 101+."""
    n = F.col("end") - F.col("start")
    bucket = F.when(n <= 0, "0").when(n <= 10, "1-10").when(n <= 20, "11-20").when(n <= 50, "21-50").when(n <= 100, "51-100").otherwise("101+")
    return flat(docs).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("spans"))


def label_counts(docs: DataFrame) -> DataFrame:
    """Spans by label, most first, then by label."""
    return flat(docs).groupBy("label").agg(F.count("*").alias("spans")).orderBy(F.desc("spans"), "label")


def token_counts(docs: DataFrame) -> DataFrame:
    """Runs of other than white space in each document."""
    return docs.select("doc_id", token_count(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


def overlapping_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, pairs) of spans that overlap, i before j; counted inside each document's array."""
    inner = lambda a, i: F.size(F.filter("spans", lambda b, j: (j > i) & (overlap(a["start"], a["end"], b["start"], b["end"]) > 0)))
    return docs.select("doc_id", F.aggregate(F.transform("spans", inner), F.lit(0), lambda x, y: x + y).cast("long").alias("pairs"))


def label_cooccurrence(docs: DataFrame) -> DataFrame:
    """(label_a, label_b, docs): documents that hold both labels, a before b. Pairs are made of each document's
    distinct labels, so no join is needed."""
    labels = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"])))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.filter("l", lambda b, j: j > i), lambda b: F.struct(a.alias("label_a"), b.alias("label_b")))))
    return docs.select(labels.alias("l")).select(F.explode(pairs).alias("p")).groupBy("p.label_a", "p.label_b").agg(F.count("*").alias("docs"))


def split_counts(docs: DataFrame, split: str = "split") -> DataFrame:
    """Documents by split; known names in their usual order, then others by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SPLIT_ORDER]), F.col("split")), F.lit(0)), F.lit(99))
    return docs.groupBy(split_bucket(F.col(split)).alias("split")).agg(F.count("*").alias("docs")).orderBy(rank, "split")


def has_splits(docs: DataFrame, split: str = "split") -> DataFrame:
    """H18."""
    return docs.agg(F.coalesce(F.bool_or(split_bucket(F.col(split)) != UNSPLIT), F.lit(False)).alias("has_splits"))


def unique_labels(docs: DataFrame) -> DataFrame:
    """Documents and sorted distinct labels."""
    return docs.select("doc_id", F.explode_outer("spans").alias("s")).agg(F.count_distinct("doc_id").alias("docs"), F.array_sort(F.collect_set("s.label")).alias("labels"))


def bundle(docs: DataFrame) -> DataFrame:
    """One row of totals and summaries from a single pass over documents."""
    d = docs.select("doc_id", F.length("text").alias("chars"), token_count(F.coalesce("text", F.lit(""))).alias("tokens"), F.size("spans").alias("n"), F.transform("spans", lambda s: s["label"]).alias("labels"))
    stats = [f(F.col(c).cast("double")).alias(f"{c}_{k}") for c in ("chars", "tokens", "n") for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
    return d.agg(F.count("*").alias("docs"), F.sum("n").alias("spans"), *stats)


def preview(docs: DataFrame, offset: int = 0, limit: int = 50, chars: int = 500) -> DataFrame:
    """One page: the first ``chars`` characters, span count, sorted labels."""
    text = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text"))
    return paging.page(docs, F.col("doc_id"), offset, limit).select("doc_id", text.alias("preview"), F.size("spans").alias("span_count"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"]))).alias("labels"))


def spans_of_label(docs: DataFrame, label: str, ignore_case: bool = False) -> DataFrame:
    """C11: (doc_id, start, end, surface) of the spans with a label."""
    same = (lambda c: F.lower(c) == label.lower()) if ignore_case else (lambda c: c == label)
    return docs.select("doc_id", "text", F.explode("spans").alias("s")).where(same(F.col("s.label"))).select("doc_id", "s.start", "s.end", surface(F.col("text"), F.col("s.start"), F.col("s.end")).alias("surface"))
