"""Merging and resolving overlapping spans. All work on a document's array of spans, so they run in
batch and on streams alike; what is order-dependent follows the array's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.packs import LABEL_RANKING
from annolake.functions.text import let
from annolake.schema import SPANS, certain, no_spans


def overlaps(a: Column, b: Column) -> Column:
    """half-open intervals that share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _length(s: Column) -> Column:
    return s["end"] - s["start"]


def _sorted(spans: Column, *keys) -> Column:
    """A stable sort: the place in the array is the last key."""
    rows = F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(rows), lambda r: r["s"])


def by_place(spans: Column) -> Column:
    """L1: by start, end, label."""
    return _sorted(spans, lambda s: s["start"], lambda s: s["end"], lambda s: s["label"])


def flags(items: Column, begin: dict[str, Column], step) -> Column:
    """array<string>: ``1`` or ``0`` for each of ``items``, by a fold. ``step`` takes the state and an item, and gives the
    flag and the new state.

    A fold copies its state at every step, arrays and rows item by item; so the state is of a few plain values, and the
    flags are one string.
    """
    state = F.struct(*[v.alias(k) for k, v in begin.items()], F.lit("").alias("flags"))

    def fold(acc, x):
        flag, new = step(acc, x)
        return F.struct(*[new[k].alias(k) for k in begin], F.concat(acc["flags"], F.when(flag, "1").otherwise("0")).alias("flags"))

    return F.aggregate(items, state, fold, lambda acc: F.split(acc["flags"], ""))


def flagged(items: Column, begin: dict[str, Column], step) -> Column:
    """The items whose flag is set."""
    return let(items, lambda x: let(flags(x, begin, step), lambda f: F.filter(x, lambda s, i: F.get(f, i) == "1")))


def runs(items: Column, firsts, one) -> Column:
    """``one(run)`` for each run of items; ``firsts(items)`` flags those that begin one, the first always."""
    places = lambda f, x: F.filter(F.transform(x, lambda s, i: F.when((i == 0) | (F.get(f, i) == "1"), i)), lambda i: i.isNotNull())
    cut = lambda x, first: F.transform(first, lambda a, j: let(F.slice(x, a + 1, F.coalesce(F.get(first, j + 1), F.size(x)) - a), one))
    return let(items, lambda x: let(firsts(x), lambda f: let(places(f, x), lambda first: cut(x, first))))


def halvings(n: Column) -> Column:
    """The powers of two that any place among n items is made of, the largest first."""
    return F.transform(F.sequence(F.ceil(F.log2(n + 1.0)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))


def halved(items: Column, n: Column, powers: Column, less) -> Column:
    """How many of n sorted ``items`` are such that ``less`` holds, by halving; ``powers``: halvings(n), held by ``let``."""
    return F.aggregate(powers, F.lit(0), lambda lo, p: F.when((lo + p <= n) & less(F.get(items, lo + p - 1)), lo + p).otherwise(lo))


def _greedy(ordered: Column, within=lambda s: F.lit("")) -> Column:
    """Of spans in order of preference those that overlap none kept before, of the same ``within``.

    The ends of all spans, sorted, cut the text into pieces; ends are found among them by halving. What is taken is one
    byte for each piece: a span is kept if its bytes are all free, which is a comparison of blocks of bytes.
    """
    point = lambda s, at: F.struct(within(s).alias("k"), s[at].alias("at"))

    def chosen(spans):
        points = F.array_sort(F.concat(F.transform(spans, lambda s: point(s, "start")), F.transform(spans, lambda s: point(s, "end"))))
        return let(points, lambda p: let(F.size(p), lambda n: let(halvings(n), lambda powers: kept(spans, p, n, powers))))

    def kept(spans, points, n, powers):
        at = lambda s, end: halved(points, n, powers, lambda x: x < point(s, end))
        pieces = F.transform(spans, lambda s: let(at(s, "start"), lambda a: F.struct(a.alias("a"), (at(s, "end") - a).alias("n"))))
        free, full = F.repeat(F.lit("0"), n).cast("binary"), F.repeat(F.lit("1"), n).cast("binary")
        return let(free, lambda free: let(full, lambda full: let(taken(pieces, free, full), lambda f: F.filter(spans, lambda s, i: F.get(f, i) == "1"))))

    def taken(pieces, free, full):
        def step(acc, p):
            open_ = F.substring(acc["taken"], p["a"] + 1, p["n"]) == F.substring(free, F.lit(1), p["n"])
            now = F.concat(F.substring(acc["taken"], F.lit(1), p["a"]), F.substring(full, F.lit(1), p["n"]), F.substring(acc["taken"], p["a"] + p["n"] + 1, F.octet_length(acc["taken"])))
            return open_, {"taken": F.when(open_, now).otherwise(acc["taken"])}

        return flags(pieces, {"taken": free}, step)

    return let(ordered, lambda x: F.when(F.size(x) > 1, chosen(x)).otherwise(x))


def _sweep(ordered: Column) -> Column:
    """Greedy selection of spans sorted by start: only the last kept one can overlap."""
    return flagged(ordered, {"end": F.lit(-1)}, lambda acc, s: (s["start"] >= acc["end"], {"end": F.when(s["start"] < acc["end"], acc["end"]).otherwise(s["end"])}))


def union(spans: Column) -> Column:
    """all spans by start, end, label."""
    return by_place(spans)


def exact_dedupe(spans: Column) -> Column:
    """the first of each (start, end, label)."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])
    return let(by_place(spans), lambda x: F.filter(x, lambda s, i: (i == 0) | ~same(F.get(x, i - 1), s)))


def longest(spans: Column) -> Column:
    """longest first, ties in array order."""
    return by_place(_greedy(_sorted(spans, lambda s: -_length(s))))


def max_confidence(spans: Column) -> Column:
    """most confident first (none counts as 1), ties in array order."""
    return by_place(_greedy(_sorted(spans, lambda s: -certain(s))))


def left_to_right(spans: Column) -> Column:
    """leftmost first, the longer of two with the same start."""
    return by_place(_sweep(_sorted(spans, lambda s: s["start"], lambda s: -_length(s))))


def label_priority(spans: Column, ranking: list[str] | None = None) -> Column:
    """F8: by the label's rank, then longest, then leftmost; labels without rank last."""
    ranking = ranking or LABEL_RANKING
    ranks = F.create_map(*[x for i, label in enumerate(ranking) for x in (F.lit(label), F.lit(i))])
    rank = lambda s: F.coalesce(ranks[s["label"]], F.lit(len(ranking)))
    return by_place(_greedy(_sorted(spans, rank, lambda s: -_length(s), lambda s: s["start"])))


def drop_overlapping(spans: Column) -> Column:
    """by start and end, the earlier one wins."""
    return _sweep(_sorted(spans, lambda s: s["start"], lambda s: s["end"]))


def for_replacement(spans: Column) -> Column:
    """longest first, then earliest, then by label; given back by start."""
    return by_place(_greedy(_sorted(spans, lambda s: -_length(s), lambda s: s["start"], lambda s: s["label"])))


def leftmost_shortest(spans: Column) -> Column:
    """K1: by start, the shorter one first."""
    return by_place(_sweep(_sorted(spans, lambda s: s["start"], _length)))


def longest_leftmost(spans: Column) -> Column:
    """K2: longest first, then leftmost."""
    return by_place(_greedy(_sorted(spans, lambda s: -_length(s), lambda s: s["start"])))


def consensus(spans: Column, threshold: int = 2, groups: str = "single") -> Column:
    """spans with votes of ``threshold`` groups at least (their own and any with an overlapping span of the same
    label), then without overlaps in a label, leftmost and longest first. ``single``: all spans are one group, so any
    threshold above 1 leaves none; ``source``: each source is a group."""
    if groups == "single":
        voted = spans if threshold <= 1 else no_spans()
    else:
        voted = _voted(spans, threshold)
    ordered = _sorted(voted, lambda s: s["start"], lambda s: -_length(s))
    return by_place(_greedy(ordered, lambda s: s["label"]))


def _voted(spans: Column, threshold: int) -> Column:
    """Spans that overlap ones of their label from ``threshold`` sources at least, their own counted. For each label and
    source, the farthest end so far is written beside the spans sorted by start; the last of them that starts before a
    span's end tells, by that end, whether any of them overlaps it."""
    group = lambda s: F.coalesce(s["source"], F.lit(""))
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(s["label"].alias("label"), group(s).alias("source"), s["start"].alias("start"), s["end"].alias("end"))))
    groups = F.array_distinct(F.transform(spans, lambda s: F.struct(s["label"].alias("label"), group(s).alias("source"))))

    def reaches(rows):
        state = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("reach"), F.lit("").alias("out"))

        def step(acc, s):
            same = F.coalesce((acc["label"] == s["label"]) & (acc["source"] == s["source"]), F.lit(False))
            reach = F.when(same, F.greatest(acc["reach"], s["end"])).otherwise(s["end"])
            return F.struct(s["label"].alias("label"), s["source"].alias("source"), reach.alias("reach"), F.concat(acc["out"], reach.cast("string"), F.lit(" ")).alias("out"))

        return F.aggregate(rows, state, step, lambda acc: F.when(acc["out"] == "", F.array().cast("array<int>")).otherwise(F.split(F.rtrim(acc["out"]), " ").cast("array<int>")))

    def overlapped(rows, reach, powers, g, s):
        first = F.struct(g["label"].alias("label"), g["source"].alias("source"), s["end"].alias("start"))
        n = halved(rows, F.size(rows), powers, lambda x: F.struct(x["label"].alias("label"), x["source"].alias("source"), x["start"].alias("start")) < first)
        last = lambda n: (F.get(rows, n - 1)["label"] == g["label"]) & (F.get(rows, n - 1)["source"] == g["source"]) & (F.get(reach, n - 1) > s["start"])
        return let(n, lambda n: F.coalesce(last(n), F.lit(False)))

    votes = lambda rows, reach, groups, powers, s: F.size(F.filter(groups, lambda g: F.when(g["label"] == s["label"], overlapped(rows, reach, powers, g, s)).otherwise(F.lit(False))))
    return let(rows, lambda r: let(reaches(r), lambda reach: let(groups, lambda g: let(halvings(F.size(r)), lambda p: F.filter(spans, lambda s: votes(r, reach, g, p, s) >= threshold)))))


def reconcile(spans: Column, gap: int = 1) -> Column:
    """spans of a label that overlap or come within ``gap`` characters become one: full extent, greatest
    confidence, source of the first."""
    begin = {"label": F.lit(None).cast("string"), "reach": F.lit(0)}

    def step(acc, s):
        joins = F.coalesce((acc["label"] == s["label"]) & (s["start"] <= acc["reach"] + gap), F.lit(False))
        return ~joins, {"label": s["label"], "reach": F.when(joins, F.greatest(acc["reach"], s["end"])).otherwise(s["end"])}

    def one(own):
        return F.struct(own[0]["start"].alias("start"), F.array_max(F.transform(own, lambda s: s["end"])).alias("end"), own[0]["label"].alias("label"), F.array_max(F.transform(own, certain)).alias("confidence"), own[0]["source"].alias("source"))

    return by_place(runs(_sorted(spans, lambda s: s["label"], lambda s: s["start"], lambda s: s["end"]), lambda x: flags(x, begin, step), one).cast(SPANS))


STRATEGIES = {"union": union, "exact_dedupe": exact_dedupe, "consensus": consensus, "max_confidence": max_confidence, "longest_non_overlapping": longest, "left_to_right": left_to_right, "label_priority": label_priority}


def resolve(docs: DataFrame, strategy="exact_dedupe", **options) -> DataFrame:
    """the named strategy, or any function of the column of spans, on each document."""
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    f = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    return docs.withColumn("spans", f(F.col("spans"), **options))


# --------------------------------------------------------------------------- flat forms


def islands(spans: DataFrame, keys: list[str], gap: int = 0, touching: bool = True) -> DataFrame:
    """Adds ``island``: runs of intervals within ``gap`` characters of the farthest end so far, numbered by ``keys``."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.col("start") > reach + gap) if touching else (F.col("start") >= reach + gap)
    return spans.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def overlap_groups(spans: DataFrame) -> DataFrame:
    """K3: (doc_id, island, start, end, n): components of overlapping spans with two members or more."""
    found = islands(spans, ["doc_id"], 0, touching=False)
    return found.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).where("n >= 2")


def keep_in_groups(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """K4: of each overlap group that holds a chosen (doc_id, start, end, label), only the chosen spans; all else stays."""
    found = islands(spans, ["doc_id"], 0, touching=False)
    key = ["doc_id", "start", "end", "label"]
    marked = found.join(chosen.select(*key).distinct().withColumn("chosen", F.lit(True)), key, "left")
    any_chosen = F.max("chosen").over(W.partitionBy("doc_id", "island"))
    return marked.withColumn("any", any_chosen).where("any IS NULL OR chosen").drop("any", "chosen", "island")


def coverage_segments(docs: DataFrame) -> DataFrame:
    """K5: (doc_id, start, end, kind) over the whole text: plain, span, or overlap by how many spans cover it."""
    ends = F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("d"))), F.transform("spans", lambda s: F.struct(s["end"].alias("at"), F.lit(-1).alias("d"))), F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("d")), F.struct(F.length("text").alias("at"), F.lit(0).alias("d"))))
    by_doc = W.partitionBy("doc_id").orderBy("at")
    points = docs.where("length(text) > 0").select("doc_id", F.explode(ends).alias("e")).groupBy("doc_id", "e.at").agg(F.sum("e.d").alias("d"))
    rows = points.withColumn("depth", F.sum("d").over(by_doc)).withColumn("end", F.lead("at").over(by_doc)).where("end IS NOT NULL")
    kind = F.when(F.col("depth") == 0, "plain").when(F.col("depth") == 1, "span").otherwise("overlap")
    # neighbours of the same depth were cut where one span ends as another begins
    return rows.select("doc_id", F.col("at").alias("start"), "end", kind.alias("kind"))


def join_duplicates(spans: DataFrame) -> DataFrame:
    """K6: one span for each (start, end, label): the greatest confidence, sources joined by +."""
    return spans.groupBy("doc_id", "start", "end", "label").agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))


def primary_labels(spans: DataFrame) -> DataFrame:
    """K7: one span for each range: the most confident, then the first label."""
    order = W.partitionBy("doc_id", "start", "end").orderBy(F.desc(F.coalesce("confidence", F.lit(1.0))), "label")
    return spans.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
