"""Operator 4: mixing sources to target weights. Hash-random keys order each source's documents, two-level prefix sums
of token counts run over ranges of the key and within the range of the cut, and each source is cut at its exact budget,
epochs repeating if needed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.common import cut

#: Hexadecimal digits of the key that number its range: 16**3 ranges a source.
RANGE_DIGITS = 3
#: Sources whose budgets and cuts may be broadcast; those of more are joined.
BROADCAST_SOURCES = 200_000


def token_count(text: Column) -> Column:
    """Runs of characters other than blanks and \\t\\n\\v\\f\\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_key(doc_id: Column, seed: str) -> Column:
    """32 hexadecimal digits that order the documents at random, alike in each run and on any partitioning."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, no target above ``cap`` times its source's size.

    Sources take the weights in turn by code point, null last. The capped ones are those of the least size per weight:
    going through the sources by that ratio, a source is capped while its ratio is below what the rest would get for
    each unit of weight. The windows see one row per source, already summed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = by_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * cap)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * F.col("left_weight") < F.col("left_words") * F.col("w"))
    first_free = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), "source", "left_words", "left_weight"))).over(everything)
    s = s.withColumn("free", first_free)
    share = F.col("w").cast("double") * F.col("free.left_words") / F.col("free.left_weight")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def source_cuts(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """For each source: source_size, target, epochs, and the place of the cut: __cut, the last place in the source's order
    that gives words in the last, broken epoch, and __part, what each document at it gives; null and 0 without such an
    epoch.

    ``sized``: source, size, __place, __range. (source, range) sums come first, added up map-side; only documents of
    the one range of each source that holds its cut are then put in order.
    """
    ranges = cut(sized.groupBy("source", "__range").agg(F.sum("size").alias("size")))
    targets = source_targets(ranges, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    budgets = cut(targets.withColumn("epochs", epochs).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("__range"))
    joined = ranges.withColumn("upto", upto).alias("a").join(budgets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    at_cut = joined.where("upto >= rest AND upto - size < rest").select(F.col("a.source").alias("__s"), F.col("__range").alias("__r"), (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))
    near = sized.join(held(at_cut), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    # equal places are one: its words are shared evenly by its documents
    places = near.groupBy("source", "__place").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("left").alias("left"))
    total = F.sum("words").over(W.partitionBy("source").orderBy("__place"))
    last = places.withColumn("upto", total).where("upto >= left AND upto - words < left").select(F.col("source").alias("__s"), F.col("__place").alias("__cut"), F.expr("(left - upto + words) div n").alias("__part"))
    return budgets.join(last, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "epochs", "__cut", F.coalesce("__part", F.lit(0)).alias("__part"))


def held(by_source: DataFrame) -> DataFrame:
    """A table of one row a source, broadcast up to BROADCAST_SOURCES of them."""
    by_source = cut(by_source)
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix-1:", range_digits: int = RANGE_DIGITS, size: Column | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source and any others) plus size, source_size, target, taken.

    ``size``: words of a document, if not those of the column text, which then need not be there.

    Budget of a source: its target, rounded. Whole epochs take each document once; the rest goes to the documents of
    the least keys, and the one at the cut gives only as many words as are left. Documents themselves are never
    shuffled: sums of 16**range_digits key ranges find the range of a source's cut, the documents of that range find
    the cut, and each document then compares its own place with it. Null text has size 0; null sources are one source;
    null doc_ids and ids that occur again are ordered by size, and rows equal in both share their place's words evenly,
    rounded down; a table without words takes nothing; an empty table gives no rows.
    """
    clash = {"size", "source_size", "target", "taken"}
    kept = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    key = hash_key(F.col("doc_id"), seed)
    sized = kept.withColumn("size", token_count(F.col("text")) if size is None else size).withColumn("__place", F.struct(key.alias("k"), "doc_id", "size"))
    narrow = sized.select("source", "size", "__place", F.substring("__place.k", 1, range_digits).alias("__range"))
    cuts = source_cuts(cut(narrow) if size is None else narrow, weights, cap)
    out = sized.join(held(cuts.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")))
    part = F.when(F.col("__place") < F.col("__cut"), F.col("size")).when(F.col("__place") == F.col("__cut"), F.col("__part")).otherwise(F.lit(0))
    taken = F.col("epochs") * F.col("size") + F.coalesce(part, F.lit(0))
    return out.withColumn("taken", taken.cast("long")).select(*kept.columns, "size", "source_size", "target", "taken")


# --------------------------------------------------------------------------- query


def op4_mix_sources(spark, sf_dir):
    """doc_id, size, source_size, target, taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # texts become counts before anything is shuffled, and are read once
    sizes = cut(docs.select("doc_id", "source", token_count(F.col("text")).alias("n")))
    return mix_sources(sizes, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
o AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lt,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lw
  FROM s),
f AS (SELECT lt, lw FROM o WHERE NOT 3 * source_size * lw < lt * w ORDER BY 3.0 * source_size / w, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size * o.lw < o.lt * w THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w AS DOUBLE) * f.lt / f.lw END AS target FROM o, f),
p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size * size + greatest(0, least(size, CAST(round(target) AS BIGINT) % source_size - b)) ELSE 0 END AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
