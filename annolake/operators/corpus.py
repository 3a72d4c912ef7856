"""Corpus transforms, sampling, splits, composition. Randomness is a hash of seed and id:
the same rows on any partitioning. What needs a rank over all documents gets it from sums of hash ranges, so that no
task ranks the corpus by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.operators.analytics import split_bucket
from annolake.operators.labels import filter_labels, map_labels

RANGES = 256


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")))


def ranked(df: DataFrame, key: Column, by: list[str] = (), tie: str = "doc_id", name: str = "rank", ranges: Column | None = None) -> DataFrame:
    """Adds the 0-based place in the order of ``key`` within ``by``: counts of ranges of the key are added up, and rows
    ranked within their range. ``ranges``: a range's name, in the key's order; the key's first two hexadecimal digits
    if there is none."""
    by = list(by)
    d = df.withColumn("__key", key)
    d = d.withColumn("__range", F.substring("__key", 1, 2) if ranges is None else ranges)
    sums = d.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__r"), before.alias("__before"))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__range") == F.col("__r"))
    place = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__key", tie)) - 1
    return d.join(starts, on).withColumn(name, (F.col("__before") + place).cast("long")).select(*df.columns, name)


def sorted_ranges(df: DataFrame, column: str, sample: int = 4096) -> Column:
    """Numbers of RANGES ranges of a column's values, about alike in size: their bounds come from a fixed-size sample of
    distinct values, so that ranks in sorted order need no task that sees them all."""
    drawn = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column), column).limit(sample).distinct().collect()
    values = sorted(r[0] for r in drawn)
    bounds = values[:: max(1, len(values) // RANGES)]
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))


#: Groups whose cuts may be broadcast; those of more are joined.
BROADCAST_GROUPS = 200_000


def _same(columns: list[str], prefix: str = "__") -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns], F.lit(True))


def places_at(docs: DataFrame, key: Column, ranks: DataFrame, by: list[str] = (), tie: str = "doc_id", ranges: Column | None = None) -> DataFrame:
    """(by, rank, place, nth): for each (by, rank) of ``ranks``, the place struct<k, t> of the row of that 0-based rank in
    the order of ``key`` and ``tie``, and how many rows of the same place come before it.

    Rows are counted in ranges of the key, which are added up; only places of the ranges that hold an asked rank are then
    put in order. Nothing but keys and counts is shuffled.
    """
    by = list(by)
    name = F.substring(key, 1, 3) if ranges is None else ranges
    narrow = docs.select(*by, F.struct(key.alias("k"), F.col(tie).alias("t")).alias("place"), name.alias("range"))
    sums = narrow.groupBy(*by, "range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("range"))
    asked = ranks.select(*[F.col(c).alias(f"__{c}") for c in by], "rank")
    held = sums.withColumn("upto", upto).join(F.broadcast(asked), _same(by) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    held = held.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("range").alias("__range"), "rank", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    on = _same([*by, "range"])
    near = narrow.join(F.broadcast(held.select(*[f"__{c}" for c in by], "__range").distinct()), on, "left_semi").groupBy(*by, "range", "place").agg(F.count("*").alias("n"))
    near = near.withColumn("upto", F.sum("n").over(W.partitionBy(*by, "range").orderBy("place")))
    found = near.join(F.broadcast(held), on & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
    return found.select(*by, "rank", "place", (F.col("left") - F.col("upto") + F.col("n")).alias("nth"))


def in_pieces(docs: DataFrame, key: Column, ranks: DataFrame, by: list[str] = (), tie: str = "doc_id", ranges: Column | None = None) -> DataFrame:
    """``docs`` with ``piece``: how many of the group's asked ranks (by, rank) are at or before the row's own.

    Documents stay where they are and compare their place with the cuts. Only rows of one place that a cut goes through,
    which have the same key and ``tie``, are numbered among themselves.
    """
    by = list(by)
    found = places_at(docs, key, ranks, by, tie, ranges)
    mine = F.struct(key.alias("k"), F.col(tie).alias("t"))
    if by:
        cuts = found.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.collect_list(F.struct("place", "nth")).alias("__cuts")).persist()
        few, split = cuts.agg(F.count("*") <= BROADCAST_GROUPS, F.max(F.exists("__cuts", lambda c: c["nth"] > 0))).first()
        d = docs.join(F.broadcast(cuts) if few else cuts, _same(by), "left").drop(*[f"__{c}" for c in by])
    else:
        rows = found.collect()  # one for each asked rank
        if not rows:
            return docs.withColumn("piece", F.lit(0))
        split = any(r["nth"] for r in rows)
        kinds = docs.select(mine.alias("m")).schema["m"].dataType
        literal = lambda r: F.struct(F.struct(F.lit(r["place"]["k"]).cast(kinds["k"].dataType).alias("k"), F.lit(r["place"]["t"]).cast(kinds["t"].dataType).alias("t")).alias("place"), F.lit(r["nth"]).cast("long").alias("nth"))
        d = docs.withColumn("__cuts", F.array(*[literal(r) for r in rows]))
    d = d.withColumn("__place", mine)
    through = F.coalesce(F.exists("__cuts", lambda c: (c["place"] == F.col("__place")) & (c["nth"] > 0)), F.lit(False))
    before = lambda nth: F.coalesce(F.size(F.filter("__cuts", lambda c: (c["place"] < F.col("__place")) | ((c["place"] == F.col("__place")) & (c["nth"] <= nth)))), F.lit(0))
    whole = d.where(~through).withColumn("piece", before(F.lit(0))) if split else d.withColumn("piece", before(F.lit(0)))
    if split:
        nth = F.row_number().over(W.partitionBy(*by, "__place").orderBy(F.lit(0))) - 1
        whole = whole.unionByName(d.where(through).withColumn("__nth", nth).withColumn("piece", before(F.col("__nth"))).drop("__nth"))
    return whole.select(*docs.columns, "piece")


# --------------------------------------------------------------------------- splits


def filter_splits(docs: DataFrame, splits: list[str] | None, split: str = "split") -> DataFrame:
    """Documents whose split is one of ``splits`` as it is written; all without any."""
    allow = [s.strip() for s in splits or [] if s and s.strip()]
    return docs.where(F.col(split).isin(allow)) if allow else docs


def filter_split_query(docs: DataFrame, splits: list[str] | None, split: str = "split") -> DataFrame:
    """By bucket: values are trimmed, and (none) is for those without one."""
    allow = [s.strip() for s in splits or [] if s and s.strip()]
    return docs.where(split_bucket(F.col(split)).isin(allow)) if allow else docs


def strip_splits(docs: DataFrame, split: str = "split") -> DataFrame:
    """C8."""
    return docs.withColumn(split, F.lit(None).cast("string"))


def work_and_rest(docs: DataFrame, splits: list[str] | None, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """What to transform and what stays, by one predicate over the same rows."""
    allow = [s.strip() for s in splits or [] if s and s.strip()]
    if not allow:
        return docs, docs.where("false")
    inside = F.coalesce(F.col(split).isin(allow), F.lit(False))
    return docs.where(inside), docs.where(~inside)


def largest_remainder(n: int, weights: list[float]) -> list[int]:
    """M3, M4: whole shares of n by weight that add up to n; weights of 0 or less get none, all alike if none is more.
    Left-over units go by remainder, the later of equals first."""
    if not weights:
        return []
    if n < 0:
        raise ValueError("n must not be negative")
    use = [w if w > 0 else 0.0 for w in weights]
    if not any(use):
        use = [1.0] * len(weights)
    total = sum(use)
    exact = [n * (w / total) for w in use]
    out = [int(x) for x in exact]
    order = sorted((i for i, w in enumerate(use) if w > 0), key=lambda i: (exact[i] - out[i], i), reverse=True)
    for i in order[: n - sum(out)]:
        out[i] += 1
    return out


def reassign_splits(docs: DataFrame, fractions: dict[str, float], seed: int = 42, shuffle: bool = True, split: str = "split") -> DataFrame:
    """M5: splits by largest remainder, in hash order or in order of doc_id."""
    names = [k for k, w in fractions.items() if w > 0]
    if not names:
        return docs
    counts = largest_remainder(docs.count(), [fractions[k] for k in names])
    ranks = docs.sparkSession.createDataFrame([(sum(counts[: i + 1]),) for i in range(len(counts) - 1)], "rank long")
    r = in_pieces(docs, shuffle_key(F.col("doc_id"), seed), ranks) if shuffle else in_pieces(docs, F.col("doc_id"), ranks, ranges=sorted_ranges(docs, "doc_id"))
    return r.withColumn(split, F.get(F.array(*[F.lit(n) for n in names]), F.col("piece"))).drop("piece")


def split_by_fraction(docs: DataFrame, cuts: dict[str, float], seed: int = 42, split: str = "split") -> DataFrame:
    """By hash alone, each document for itself: no count, no rank, and stable as documents are added."""
    unit = F.conv(F.substring(shuffle_key(F.col("doc_id"), seed), 1, 8), 16, 10).cast("double") / 2**32
    out, upto = F.lit(list(cuts)[-1]), sum(list(cuts.values())[:-1])
    for name, share in reversed(list(cuts.items())[:-1]):
        out = F.when(unit < upto, name).otherwise(out)
        upto -= share
    return docs.withColumn(split, out)


# --------------------------------------------------------------------------- sizes


def clone(docs: DataFrame, doc_id: Column) -> DataFrame:
    """M17."""
    return docs.withColumn("doc_id", doc_id)


def resize(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """M1: exactly n documents: the first n in hash order, or all plus drawn copies named {id}__rs{k}."""
    if n < 0:
        raise ValueError("n must not be negative")
    have = docs.count()
    as_text = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    if n == 0 or not have:
        return as_text.limit(0)
    if n <= have:
        if n == have:
            return as_text
        return in_pieces(as_text, shuffle_key(F.col("doc_id"), seed), docs.sparkSession.createDataFrame([(n,)], "rank long")).where("piece = 0").drop("piece")
    draws = docs.sparkSession.range(1, n - have + 1).select(F.col("id").alias("__k"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(have)).alias("rank"))
    copies = ranked(as_text, shuffle_key(F.col("doc_id"), seed)).join(draws, "rank")
    return as_text.unionByName(clone(copies, F.concat("doc_id", F.lit("__rs"), F.col("__k").cast("string"))).select(as_text.columns))


def boost(docs: DataFrame, label: str, copies: int, prefix: str = "b") -> DataFrame:
    """M2: documents with a span of ``label`` come ``copies`` times more, named {id}__{prefix}{k} with k over all copies."""
    as_text = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    if copies <= 0:
        return as_text
    with_label = as_text.where(F.exists("spans", lambda s: s["label"] == label))
    r = ranked(with_label, shuffle_key(F.col("doc_id"), 0)).withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return as_text.unionByName(clone(r, F.concat("doc_id", F.lit(f"__{prefix}"), (F.col("rank") * copies + F.col("__c")).cast("string"))).select(as_text.columns))


def sample(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N documents in hash order, by a top-k."""
    return docs.orderBy(shuffle_key(F.col("doc_id"), seed), "doc_id").limit(n)


# --------------------------------------------------------------------------- composition


def flatten_source(docs: DataFrame, index: int, prefix: str = "s", provenance: bool = True) -> DataFrame:
    """M9: ids {prefix}{index}__{id}, no split, and where each document came from."""
    out = docs.withColumn("source_index", F.lit(index)).withColumn("original_id", F.col("doc_id").cast("string")).withColumn("original_split", F.col("split") if "split" in docs.columns else F.lit(None).cast("string"))
    out = clone(out, F.concat(F.lit(f"{prefix}{index}__"), F.col("doc_id").cast("string")))
    out = strip_splits(out) if "split" in docs.columns else out
    return out if provenance else out.drop("original_id", "original_split")


def merge(sources: list[DataFrame], shuffle: bool = False, seed: int = 42) -> DataFrame:
    """All sources; their order is theirs, or with ``shuffle`` by the hash of seed and id."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return out.orderBy(shuffle_key(F.col("doc_id"), seed), "doc_id") if shuffle else out


def interleave(sources: DataFrame, source: str = "source_index", order: str = "doc_id") -> DataFrame:
    """``turn`` of each document when sources take turns: its rank in its source; sort by turn, then source."""
    return ranked(sources, F.col(order), [source], order, "turn", sorted_ranges(sources, order))


def capped_counts(n: int, weights: list[float], caps: list[int]) -> list[int]:
    """Shares by weight up to caps; what is over goes one by one to the source of most weight, first of equals."""
    t = max(0, min(n, sum(caps)))
    out = [min(a, b) for a, b in zip(largest_remainder(t, weights), caps)]
    left = t - sum(out)
    for i in sorted(range(len(caps)), key=lambda i: (-weights[i], i)):
        more = min(left, caps[i] - out[i])
        out[i] += more
        left -= more
    return out


def proportional(sources: DataFrame, weights: dict, n: int | None = None, seed: int = 42, source: str = "source") -> DataFrame:
    """Without replacement, sources by weight up to their size. The driver sees one count for each source."""
    caps = {r[0]: r[1] for r in sources.groupBy(source).agg(F.count("*")).collect()}
    names = [k for k in weights if k in caps]
    counts = capped_counts(sum(caps[k] for k in names) if n is None else n, [weights[k] for k in names], [caps[k] for k in names])
    spark, kind = sources.sparkSession, sources.schema[source].dataType.simpleString()
    chosen = spark.createDataFrame([(k,) for k in names], f"__chosen {kind}")
    few = len(names) <= BROADCAST_GROUPS
    own = sources.join(F.broadcast(chosen) if few else chosen, F.col(source).eqNullSafe(F.col("__chosen")), "left_semi")
    ranks = spark.createDataFrame([(k, c) for k, c in zip(names, counts) if c < caps[k]], f"{source} {kind}, rank long")
    return in_pieces(own, shuffle_key(F.col("doc_id"), seed), ranks, [source]).where("piece = 0").drop("piece")


def compose(sources: list[DataFrame], strategy: str = "merge", weights: list[float] | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Flattens the sources, then merges, interleaves or samples them."""
    flat = merge([flatten_source(d, i) for i, d in enumerate(sources)])
    if strategy == "merge":
        return flat
    if strategy == "interleave":
        return interleave(flat)
    if strategy == "proportional":
        return proportional(flat, dict(enumerate(weights or [1.0] * len(sources))), n, seed, "source_index")
    raise ValueError(f"unknown strategy {strategy!r}")


# --------------------------------------------------------------------------- transform


def transform(docs: DataFrame, drop=None, keep=None, mapping=None, resize_to=None, boost_label=None, boost_copies=0, fractions=None, strip=False, seed: int = 42) -> DataFrame:
    """M6: labels are filtered, then mapped; then documents boosted, resized, splits stripped or dealt anew."""
    out = filter_labels(docs, drop, keep)
    out = map_labels(out, mapping) if mapping else out
    out = boost(out, boost_label, boost_copies) if boost_label else out
    out = resize(out, resize_to, seed) if resize_to is not None else out
    out = strip_splits(out) if strip else out
    return reassign_splits(out, fractions, seed) if fractions else out


def transform_splits(docs: DataFrame, splits: list[str], **steps) -> DataFrame:
    """M7: the transform on documents of some splits, all others as they were."""
    work, rest = work_and_rest(docs, splits)
    return rest.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(transform(work, **steps).withColumn("doc_id", F.col("doc_id").cast("string")))


def transform_preview(docs: DataFrame, drop: list[str] = (), mapping: dict | None = None) -> DataFrame:
    """What a filter and a mapping would do: spans kept, dropped and renamed, from one pass."""
    gone = lambda s: s["label"].isin(list(drop)) if drop else F.lit(False)
    named = lambda s: s["label"].isin([k for k, v in (mapping or {}).items() if v != k]) if mapping else F.lit(False)
    count = lambda f: F.coalesce(F.sum(F.size(F.filter("spans", f))), F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("docs"), count(lambda s: F.lit(True)).alias("spans"), count(gone).alias("dropped"), count(lambda s: named(s) & ~gone(s)).alias("renamed"))


def unique_names(df: DataFrame, base: str, order: list[str], name: str = "stem") -> DataFrame:
    """Base, base__2, base__3 in order; a base of any share of the rows is ranked over ranges of the order."""
    d = ranked(df, F.col(order[0]), [base], tie=order[-1], name="__nth", ranges=sorted_ranges(df, order[0]))
    return d.withColumn(name, F.when(F.col("__nth") == 0, F.col(base)).otherwise(F.concat(base, F.lit("__"), (F.col("__nth") + 1).cast("string")))).drop("__nth")


