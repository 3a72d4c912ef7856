"""Spans that the catalogue's queries work on: two pattern packs over ``documents``, one as predicted, one as gold, and
the same spans in DuckDB SQL. The patterns use only what Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions.groups import pieces
from annolake.operators import detect
from annolake.sources.readers import spread

PRED = {"NAME": [r"[A-Z][a-z]+ed[a-z]* [a-z]+"], "CITY": [r"[a-z]+ion[a-z]*\. "], "DATE": [r"the [a-z]{3,4}ed"], "ID": [r"[0-9]+"], "EMAIL": [r"[a-z0-9._]+@[a-z0-9.]+[a-z]"]}
GOLD = {"NAME": [r"[A-Z][a-z]+ed[a-z]*"], "PLACE": [r"[a-z]+ion[a-z]*\. "], "DATE": [r"the [a-z]{3}ed"], "ID": [r"[0-9]{2,}"], "EMAIL": [r"[a-z0-9._]+@[a-z0-9.]+[a-z]"]}


def docs(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def pred(spark, sf_dir):
    """Predicted spans with varied confidences and sources, so that every sort key counts."""
    d = detect.regex_ner(docs(spark, sf_dir), PRED, dedupe=False, flags="")
    mark = lambda s: s.withField("confidence", F.when(s["start"] % 5 != 0, ((s["start"] * 7 + s["end"]) % 10) / 10.0)).withField("source", F.concat(F.lit("s"), (s["start"] % 3).cast("string")))
    return d.withColumn("spans", F.transform("spans", mark))


def gold(spark, sf_dir):
    return detect.regex_ner(docs(spark, sf_dir), GOLD, dedupe=False, flags="")


def has_group(pattern: str) -> bool:
    return bool(pieces(pattern).entities)


def both_packs(spark, sf_dir):
    """Documents with both packs' spans, ``pred`` and ``gold``, from one scan."""
    d = pred(spark, sf_dir).withColumnRenamed("spans", "pred")
    return detect.regex_ner(d, GOLD, dedupe=False, flags="").withColumnRenamed("spans", "gold")


def both_sides(spark, sf_dir):
    """(doc_id, side, span_ord, start, end, label, confidence, source): both packs' spans from one scan, marked by side."""
    d = both_packs(spark, sf_dir)
    marked = lambda side: F.transform(side, lambda s, i: F.struct(F.lit(side).alias("side"), i.alias("span_ord"), s.alias("s")))
    return d.select("doc_id", F.explode_outer(F.concat(marked("pred"), marked("gold"))).alias("x")).where("x IS NOT NULL").select("doc_id", "x.side", "x.span_ord", "x.s.*")


def _one(label: str, rx: str, base: str) -> str:
    rx = rx.replace("'", "''")
    return f"""
  SELECT doc_id, '{label}' AS label, CAST(st AS INTEGER) AS "start", CAST(st + length(t) AS INTEGER) AS "end", t AS surface FROM (
    SELECT doc_id, i, t, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (
      SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(text, '{rx}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM {base} WHERE regexp_matches(text, '{rx}')))) WHERE i % 2 = 0"""


def spans_sql(pack: dict, extra: str = "", base: str = "documents") -> str:
    body = " UNION ALL ".join(_one(k, v[0], base) for k, v in pack.items())
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label) - 1 AS INTEGER) AS span_ord{extra} FROM ({body})"""


PRED_SQL = "pred AS (" + spans_sql(PRED, """, CASE WHEN "start" % 5 <> 0 THEN CAST(("start" * 7 + "end") % 10 AS DOUBLE) / 10.0 END AS confidence, 's' || CAST("start" % 3 AS VARCHAR) AS source""") + ")"
GOLD_SQL = "gold AS (" + spans_sql(GOLD) + ")"


def greedy_sql(order: str, base: str = "pred", clash: str = "TRUE") -> str:
    """Recursive greedy selection of ``base`` in an order; ``clash`` narrows which overlaps count."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r FROM {base}),
walk(doc_id, r, kept) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(s INTEGER, e INTEGER, l VARCHAR, r BIGINT)[]) FROM ordered
  UNION ALL
  SELECT o.doc_id, o.r, CASE WHEN len(list_filter(kept, lambda k: k.s < o."end" AND o."start" < k.e AND ({clash}))) = 0
                             THEN list_append(kept, {{'s': o."start", 'e': o."end", 'l': o.label, 'r': o.r}}) ELSE kept END
  FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.r = w.r + 1),
taken AS (SELECT doc_id, unnest(kept).r AS r FROM (SELECT doc_id, kept FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) = 1)),
chosen AS (SELECT o.* FROM ordered o JOIN taken t ON o.doc_id = t.doc_id AND o.r = t.r)"""
