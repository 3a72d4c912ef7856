"""Differences between span sets and texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "start", "end", "label"]


def span_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """K8: each distinct span with its status: added, removed or kept; one grouping of both sides."""
    both = before.select(*KEY, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*KEY, F.lit(0).alias("b"), F.lit(1).alias("a")))
    status = F.when((F.col("b") == 1) & (F.col("a") == 1), "kept").when(F.col("a") == 1, "added").otherwise("removed")
    return both.groupBy(*KEY).agg(F.max("b").alias("b"), F.max("a").alias("a")).select(*KEY, status.alias("status"))


def pipeline_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """K9: ranges by (agreed, only_a, only_b, relabeled) over all documents; a range whose labels differ is relabeled."""
    one = lambda df, n: df.groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set("label")).alias(n))
    both = one(a, "a").join(one(b, "b"), ["doc_id", "start", "end"], "full_outer")
    kind = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") == F.col("b"), "agreed").otherwise("relabeled")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def frame_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each document of two steps (nested): spans added and removed, whether the text changed, and by how much."""
    key = lambda c: F.array_distinct(F.transform(c, lambda s: F.struct(s["start"], s["end"], s["label"])))
    j = before.select("doc_id", F.col("text").alias("t0"), key(F.col("spans")).alias("s0")).join(after.select("doc_id", F.col("text").alias("t1"), key(F.col("spans")).alias("s1")), "doc_id")
    return j.select("doc_id", F.size(F.array_except("s1", "s0")).alias("added"), F.size(F.array_except("s0", "s1")).alias("removed"), (F.col("t0") != F.col("t1")).alias("text_changed"), (F.length("t1") - F.length("t0")).alias("char_delta"))


def label_conflicts(a: DataFrame, b: DataFrame, final: DataFrame) -> DataFrame:
    """Ranges that two detectors label differently, with the labels that ended on them."""
    hit = a.select("doc_id", "start", "end", F.col("label").alias("label_a")).distinct().join(b.select("doc_id", "start", "end", F.col("label").alias("label_b")).distinct(), ["doc_id", "start", "end"]).where("label_a != label_b")
    ended = final.groupBy("doc_id", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("final_labels"))
    return hit.join(ended, ["doc_id", "start", "end"], "left")


def fingerprint(text: Column, spans: Column) -> Column:
    """A hash of the text and of its spans in whatever order."""
    keys = F.array_sort(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])))
    return F.concat(F.md5(text), F.lit("-"), F.md5(F.array_join(keys, "\n")))


def word_diff(a: Column, b: Column) -> Column:
    """array<struct<op, text>>: equal, add and remove runs of words. There is no built-in alignment of two
    sequences; batches go through Arrow."""
    @F.pandas_udf("array<struct<op:string,text:string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for old, new in zip(x, y):
            u, v, ops = (old or "").split(), (new or "").split(), []
            for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=u, b=v, autojunk=False).get_opcodes():
                if tag == "equal":
                    ops.append({"op": "equal", "text": " ".join(u[i1:i2])})
                    continue
                if i2 > i1:
                    ops.append({"op": "remove", "text": " ".join(u[i1:i2])})
                if j2 > j1:
                    ops.append({"op": "add", "text": " ".join(v[j1:j2])})
            out.append(ops)
        return pd.Series(out)

    return run(a, b)
