"""Predicted spans against gold ones. Inputs are flat spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.packs import RiskProfile
from annolake.functions.text import let, overlap, ratio
from annolake.operators.labels import weight
from annolake.operators.resolve import islands


def prf(df: DataFrame) -> DataFrame:
    """H1: precision, recall and f1 of tp, fp, fn; 0 where undefined."""
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def sides(pred: DataFrame, gold: DataFrame | None, columns: list[str]) -> DataFrame:
    """Both sides' spans as rows with ``side`` (pred or gold). Where ``pred`` holds both, with that column, ``gold`` is None:
    spans that come from one scan of the texts then need no second one."""
    if gold is None:
        return pred.select(*columns, "side")
    return pred.select(*columns, F.lit("pred").alias("side")).unionByName(gold.select(*columns, F.lit("gold").alias("side")))


def matched(pred: DataFrame, gold: DataFrame | None, on: list[str], by: list[str]) -> DataFrame:
    """Tp, fp, fn by ``by`` over distinct keys ``on``: both sides meet in one grouping, without a join."""
    rows = sides(pred, gold, on).select(*on, (F.col("side") == "pred").cast("int").alias("p"), (F.col("side") == "gold").cast("int").alias("g"))
    keys = rows.groupBy(*on).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    p, g = F.col("p") == 1, F.col("g") == 1
    return (keys.groupBy(*by) if by else keys.groupBy()).agg(count(p & g).alias("tp"), count(p & ~g).alias("fp"), count(~p & g).alias("fn"))


STRICT = ["doc_id", "start", "end", "label"]
BOUNDARY = ["doc_id", "start", "end"]


def strict(pred: DataFrame, gold: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    return matched(pred, gold, STRICT, list(by))


def boundary(pred: DataFrame, gold: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    return matched(pred, gold, BOUNDARY, list(by))


def _islands(pred: DataFrame, gold: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, island, pred, gold): spans of both sides in runs that overlap, each side's in list order. Spans of different
    islands share no character, so whatever compares overlapping spans may go by island."""
    both = islands(sides(pred, gold, ["doc_id", "label", "start", "end", "span_ord"]), keys, 0, touching=False)
    own = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("span_ord", "start", "end", "label")))).alias(name)
    return both.groupBy(*keys, "island").agg(own("pred"), own("gold"))


def partial(pred: DataFrame, gold: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Predicted spans, in order, each take the free gold span of their label that they overlap most, the first of
    equals. Different labels never meet, so the fold runs over islands of one label."""
    rows = _islands(pred, gold, ["doc_id", "label"])
    state = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("partial"))

    def step(acc, p):
        scored = F.transform("gold", lambda g, i: F.struct(F.when(F.array_contains(acc["taken"], i), 0).otherwise(overlap(p["start"], p["end"], g["start"], g["end"])).alias("n"), (-i).alias("i")))
        take = lambda b: F.struct(F.concat(acc["taken"], F.array(-b["i"])).alias("taken"), (acc["partial"] + F.when((F.get("gold", -b["i"])["start"] == p["start"]) & (F.get("gold", -b["i"])["end"] == p["end"]), 0).otherwise(1)).alias("partial"))
        return let(F.array_max(scored), lambda b: F.when(b["n"] > 0, take(b)).otherwise(acc))

    met = (F.size("gold") > 0) & (F.size("pred") > 0)
    done = rows.withColumn("m", F.when(met, F.aggregate("pred", state, step)).otherwise(state))
    n = F.size("m.taken")
    counted = done.select("doc_id", "label", n.alias("tp"), (F.size("pred") - n).alias("fp"), (F.size("gold") - n).alias("fn"), F.col("m.partial").alias("partial"))
    return (counted.groupBy(*by) if by else counted.groupBy()).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "partial")])


def tag_segments(spans: DataFrame, keys: list[str] = ("doc_id",)) -> DataFrame:
    """(keys, start, end, label, begins): disjoint pieces of text, each with the label of the first span over it by
    start, then length, then order; ``begins`` where that span begins, so that the first character's tag is B-.

    In that order, all spans before one start no later than it does; what they cover of it is all before the farthest of
    their ends. So a span's piece begins there, and one sorted pass over spans, not characters, finds it.
    """
    w = W.partitionBy(*keys).orderBy("start", F.col("start") - F.col("end"), "span_ord").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(-1)))
    return spans.withColumn("__from", reach).where("__from < end").select(*keys, F.col("__from").alias("start"), "end", "label", (F.col("__from") == F.col("start")).alias("begins"))


def char_tags(spans: DataFrame) -> DataFrame:
    """(doc_id, pos, tag), a row for each character inside spans, for those who need them one by one."""
    each = tag_segments(spans).select("doc_id", "label", "begins", "start", F.explode(F.expr("sequence(start, end - 1)")).alias("pos"))
    return each.select("doc_id", "pos", F.concat(F.when(F.col("begins") & (F.col("pos") == F.col("start")), "B-").otherwise("I-"), F.col("label")).alias("tag"))


def characters(pred: DataFrame, gold: DataFrame | None = None, by_doc: bool = False) -> DataFrame:
    """H5: tags compared by character; two different tags are both a false positive and a false negative. Both sides'
    changes of tag are swept together: three rows for each segment at most, shuffled once, by document."""
    keys = ["doc_id", "side"]
    seg = tag_segments(sides(pred, gold, ["doc_id", "span_ord", "start", "end", "label"]).repartition("doc_id"), keys)
    following = F.lead("start").over(W.partitionBy(*keys).orderBy("start"))
    change = lambda at, tag: F.struct(at.alias("pos"), tag.alias("tag"))
    b, i, none = F.concat(F.lit("B-"), "label"), F.concat(F.lit("I-"), "label"), F.lit("")
    changes = F.array(
        F.when(F.col("begins"), change(F.col("start"), b)).otherwise(change(F.col("start"), i)),
        F.when(F.col("begins") & (F.col("end") > F.col("start") + 1), change(F.col("start") + 1, i)),
        F.when(following.isNull() | (following > F.col("end")), change(F.col("end"), none)),
    )
    rows = seg.withColumn("changes", changes).select("doc_id", "side", F.explode(F.filter("changes", lambda c: c.isNotNull())).alias("c"))
    upto = W.partitionBy("doc_id").orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    tag = lambda name: F.coalesce(F.last(F.when(F.col("side") == name, F.col("tag")), ignorenulls=True).over(upto), F.lit(""))
    n = F.lead("pos").over(W.partitionBy("doc_id").orderBy("pos")) - F.col("pos")
    both = rows.select("doc_id", "side", "c.pos", "c.tag").select("doc_id", tag("pred").alias("p"), tag("gold").alias("g"), F.coalesce(n, F.lit(0)).alias("n"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    p, g, same = F.col("p") != "", F.col("g") != "", F.col("p") == F.col("g")
    return (both.groupBy("doc_id") if by_doc else both.groupBy()).agg(count(p & same).alias("tp"), count(p & ~same).alias("fp"), count(g & ~same).alias("fn"))


def per_label(pred: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """H3: strict counts, ratios and support (gold spans, each counted) by label, from one grouping of both sides."""
    keys = sides(pred, gold, STRICT).groupBy(*STRICT).agg(F.count_if(F.col("side") == "pred").alias("p"), F.count_if(F.col("side") == "gold").alias("g"))
    count = lambda c: F.count_if(c).cast("long")
    p, g = F.col("p") > 0, F.col("g") > 0
    counts = keys.groupBy("label").agg(count(p & g).alias("tp"), count(p & ~g).alias("fp"), count(~p & g).alias("fn"), F.sum("g").alias("support"))
    return prf(counts).select("label", "tp", "fp", "fn", "precision", "recall", "f1", "support")


def swapped(both: DataFrame) -> DataFrame:
    """Both sides' spans, what was predicted as gold and what was gold as predicted."""
    return both.withColumn("side", F.when(F.col("side") == "pred", "gold").otherwise("pred"))


def macro(labels: DataFrame) -> DataFrame:
    """H4: the labels' mean precision, recall, f1; zeros without labels."""
    return labels.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("label_count"))


def false_negatives(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold spans that no predicted one equals; repeated ones each count."""
    return gold.join(pred.select(*STRICT).distinct(), STRICT, "left_anti")


def false_positives(pred: DataFrame, gold: DataFrame) -> DataFrame:
    return false_negatives(gold, pred)


def low_confidence(pred: DataFrame, gold: DataFrame, below: float) -> DataFrame:
    """C14: false positives of a confidence below ``below``; none is never low."""
    return false_positives(pred, gold).where(F.col("confidence") < below)


def confusion(pred: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(gold_label, pred_label, n): a gold span counts under the label of the predicted span that it overlaps
    most, the first of equals, or <MISSED>; predicted spans that no gold one chose under <SPURIOUS>."""
    rows = _islands(pred, gold, ["doc_id"])
    best = F.transform("gold", lambda g: F.struct(g["label"].alias("label"), F.array_max(F.transform("pred", lambda p, i: F.struct(overlap(p["start"], p["end"], g["start"], g["end"]).alias("n"), (-i).alias("i")))).alias("b")))
    rows = rows.withColumn("best", best)
    hit = lambda b: F.coalesce(b["b"]["n"] > 0, F.lit(False))
    used = F.transform(F.filter("best", hit), lambda b: -b["b"]["i"])
    of_gold = F.transform("best", lambda b: F.struct(b["label"].alias("gold_label"), F.when(hit(b), F.get("pred", -b["b"]["i"])["label"]).otherwise("<MISSED>").alias("pred_label")))
    spurious = F.transform(F.filter("pred", lambda p, i: ~F.array_contains("used", i)), lambda p: F.struct(F.lit("<SPURIOUS>").alias("gold_label"), p["label"].alias("pred_label")))
    cells = rows.withColumn("used", used).select(F.explode(F.concat(of_gold, spurious)).alias("c"))
    return cells.groupBy("c.gold_label", "c.pred_label").agg(F.count("*").alias("n"))


def risk_weighted_recall(pred: DataFrame, gold: DataFrame | None, profile: RiskProfile | dict, default: float = 1.0) -> DataFrame:
    """1 less the missed share of the gold spans' risk, at least 0; 1 without gold or weight. Both sides meet in one
    grouping, in which equal gold spans each count."""
    weights, default = (profile.weights, profile.default_weight) if isinstance(profile, RiskProfile) else (profile, default)
    keys = sides(pred, gold, STRICT).groupBy(*STRICT).agg(F.count_if(F.col("side") == "pred").alias("p"), F.count_if(F.col("side") == "gold").alias("g"))
    risk = F.col("g") * weight(F.col("label"), weights, default)
    both = keys.where("g > 0").agg(F.coalesce(F.sum(risk), F.lit(0.0)).alias("gold_weight"), F.coalesce(F.sum(F.when(F.col("p") == 0, risk)), F.lit(0.0)).alias("missed_weight"))
    return both.withColumn("risk_weighted_recall", F.when(F.col("gold_weight") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("missed_weight") / F.col("gold_weight"))).otherwise(1.0))


def coverage(labels: DataFrame, profile: RiskProfile) -> DataFrame:
    """H8: (identifier, name, status) for a table of labels: covered if all labels of the identifier are there, partial
    if some are, n/a if it isn't required."""
    spark = labels.sparkSession
    ids = spark.createDataFrame([(k, n, r, sum(k in v for v in profile.covers.values())) for k, (n, r) in profile.identifiers.items()], "identifier string, name string, required boolean, of int")
    covers = spark.createDataFrame([(x, k) for x, ks in profile.covers.items() for k in ks], "label string, identifier string")
    there = labels.select("label").distinct().join(F.broadcast(covers), "label").groupBy("identifier").agg(F.count("*").alias("there"))
    n = F.coalesce("there", F.lit(0))
    status = F.when(~F.col("required"), "n/a").when(n == 0, "uncovered").when(n == F.col("of"), "covered").otherwise("partial")
    return ids.join(there, "identifier", "left").select("identifier", "name", status.alias("status"))


def worst_documents(docs: DataFrame, pred: DataFrame, gold: DataFrame, n: int | None = None) -> DataFrame:
    """Documents by strict f1, those without any span last, more gold spans first, then doc_id; ``rank`` from 1.
    With a number, a top-k; without, a global sort that only writes rank by partitions of the sorted rows."""
    size = gold.groupBy("doc_id").agg(F.count("*").alias("n_gold"))
    scored = docs.select("doc_id").join(prf(strict(pred, gold, ["doc_id"])), "doc_id", "left").join(size, "doc_id", "left")
    scored = scored.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "n_gold")], F.coalesce("f1", F.lit(0.0)).alias("f1"))
    quiet = (F.col("tp") + F.col("fp") + F.col("fn") == 0).cast("int")
    order = [quiet, F.col("f1"), F.desc("n_gold"), F.col("doc_id")]
    if n is None:
        return scored.orderBy(*order)
    top = scored.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def compare_runs(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """b's metrics less a's, rounded to 6 places."""
    return a.alias("a").join(b.alias("b"), key).select(key, *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(m) for m in metrics])


def bundle(pred: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """The four modes' counts and ratios, one row each."""
    modes = [("strict", strict(pred, gold)), ("exact_boundary", boundary(pred, gold)), ("partial_overlap", partial(pred, gold).drop("partial")), ("char_level", characters(pred, gold))]
    out = None
    for name, df in modes:
        row = prf(df.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])).withColumn("mode", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def tag_report(tags: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of each tag of (gold, pred) token rows."""
    g = tags.groupBy(F.col("gold").alias("tag")).agg(F.count("*").alias("support"), F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("tp"))
    p = tags.groupBy(F.col("pred").alias("tag")).agg(F.count("*").alias("n"))
    both = g.join(p, "tag", "full_outer").select("tag", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "n")])
    return prf(both.select("tag", "support", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn")))


def remapped_tags(tags: DataFrame, mode: str = "bio") -> DataFrame:
    """(gold, pred) tags as they are (bio), without B- and I- (token), or as O and PHI (binary)."""
    if mode == "bio":
        return tags
    kind = lambda c: F.when(F.col(c) == "O", "O").otherwise(F.regexp_replace(c, "^[BIES]-", "") if mode == "token" else F.lit("PHI")).alias(c)
    if mode not in ("token", "binary"):
        raise ValueError(f"unknown mode {mode!r}")
    return tags.select(*[kind(c) if c in ("gold", "pred") else F.col(c) for c in tags.columns])


def entity_report(gold: DataFrame, pred: DataFrame | None = None) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) of whole entities of two tables of tag rows (doc_id, n,
    start, end, tag), with a last row ``micro`` over all. Instead of two tables, one whose rows are all tokens with tags
    ``gold`` and ``pred``, n without gaps: then only tagged rows are shuffled."""
    from annolake.operators.tagging import entities_of_rows

    if pred is None:
        tags = F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("tag")) for x in ("gold", "pred")])
        each = gold.where("gold != 'O' OR pred != 'O'").select("doc_id", "n", "start", "end", F.explode(tags).alias("x"))
        entities = entities_of_rows(each.select(F.struct("doc_id", "x.side").alias("doc_id"), "n", "start", "end", "x.tag"), gapless=True).select("doc_id.*", "start", "end", "label")
    else:
        side = lambda df, name: entities_of_rows(df).select("doc_id", "start", "end", "label", F.lit(name).alias("side"))
        entities = side(gold, "gold").unionByName(side(pred, "pred"))
    both = entities.groupBy("doc_id", "start", "end", "label").agg(F.max((F.col("side") == "gold").cast("long")).alias("g"), F.max((F.col("side") == "pred").cast("long")).alias("p"))
    counts = [F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"), F.sum("g").alias("support")]
    names = ("tp", "fp", "fn", "support")
    own = both.groupBy("label").agg(*counts).select(F.lit(False).alias("all"), "label", *names)
    none = both.sparkSession.range(1).select(F.lit(True).alias("all"), F.lit("micro").alias("label"), *[F.lit(0).cast("long").alias(c) for c in names])
    each = F.array(*[F.struct(F.lit(x).alias("all"), y.alias("label")) for x, y in ((False, F.col("label")), (True, F.lit("micro")))])
    twice = own.select(F.explode(each).alias("x"), *names).select("x.*", *names)  # so that entities are found once for both
    return prf(none.unionByName(twice).groupBy("all", "label").agg(*[F.sum(c).alias(c) for c in names]).drop("all"))
