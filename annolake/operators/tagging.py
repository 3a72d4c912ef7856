"""Tokens, sentences and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.text import let, matches, surface
from annolake.functions.words import tagged_documents, tagged_words, words
from annolake.schema import SPANS, exploded

TOKENS = "array<struct<start:int,end:int,text:string>>"


def tokens(text: Column) -> Column:
    """Runs of other than white space with their places."""
    return words(text)


def _first(items: Column, ok) -> Column:
    """The place of the first of ``items`` that is ok, all after it being so too: found by halving."""
    half = lambda x: ((x["lo"] + x["hi"]) / 2).cast("int")
    bounds = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    step = lambda x, _: F.when(x["lo"] >= x["hi"], x).when(ok(F.get(items, half(x))), bounds(x["lo"], half(x))).otherwise(bounds(half(x) + 1, x["hi"]))
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))
    return F.aggregate(turns, bounds(F.lit(0), F.size(items)), step)["lo"]


def tagged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with tokens and a BIO tag for each. Spans go by start, longest first; each gives
    B to its first free token and I to those after it."""
    return tagged_documents(docs, docs.columns if keep is None else keep)


#: Characters of one bin of a document: intervals meet in the bins that both reach into.
BIN = 256


def in_bins(df: DataFrame, start: str, end: str) -> DataFrame:
    """``df`` with a row for each bin that [start, end) reaches into."""
    return df.withColumn("__bin", F.explode(_bins(F.col(start), F.col(end))))


def _bins(start: Column, end: Column) -> Column:
    return F.sequence((start / BIN).cast("int"), ((F.greatest(end, start + 1) - 1) / BIN).cast("int"))


def bio_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, token, tag): a row for each token and its tag, without a shuffle."""
    return tag_rows(docs, {"tag": "spans"}).select("doc_id", "n", F.col("text").alias("token"), "tag")


def tag_rows(docs: DataFrame, tags: dict[str, str]) -> DataFrame:
    """(doc_id, n, start, end, text) and columns of ``tags`` (name -> column of spans): a row for each token, without a
    shuffle."""
    return tagged_words(docs, ["doc_id"], tags)


def tag_list(docs: DataFrame) -> DataFrame:
    """O, then B and I of each label in order."""
    labels = docs.select(F.explode("spans").alias("s")).agg(F.array_sort(F.collect_set("s.label")).alias("l"))
    return labels.select(F.concat(F.array(F.lit("O")), F.flatten(F.transform("l", lambda x: F.array(F.concat(F.lit("B-"), x), F.concat(F.lit("I-"), x))))).alias("tags"))


def bioes(tags: Column) -> Column:
    """The last token of an entity ends in E, a lone one is S."""
    nxt = lambda i: F.coalesce(F.get(tags, i + 1), F.lit("O"))
    goes_on = lambda t, i: F.startswith(nxt(i), F.lit("I-")) & (F.substring(nxt(i), 3, 999) == F.substring(t, 3, 999))
    return F.transform(tags, lambda t, i: F.when(t == "O", t).when(goes_on(t, i), t).when(F.startswith(t, F.lit("B-")), F.concat(F.lit("S-"), F.substring(t, 3, 999))).otherwise(F.concat(F.lit("E-"), F.substring(t, 3, 999))))


def bio_of_bioes(tags: Column) -> Column:
    """E9, back."""
    return F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("S-")), F.concat(F.lit("B-"), F.substring(t, 3, 999))).when(F.startswith(t, F.lit("E-")), F.concat(F.lit("I-"), F.substring(t, 3, 999))).otherwise(t))


def valid_bio(tags: Column) -> Column:
    """No I follows anything but a B or I of its label."""
    before = lambda i: F.when(i == 0, "O").otherwise(F.get(tags, i - 1))
    bad = F.transform(tags, lambda t, i: F.startswith(t, F.lit("I-")) & ((before(i) == "O") | (F.substring(before(i), 3, 999) != F.substring(t, 3, 999))))
    return ~F.array_contains(bad, True)


def entities_of_rows(rows: DataFrame, gapless: bool = False) -> DataFrame:
    """(doc_id, island, start, end, label) of BIO rows (doc_id, n, start, end, tag), broken by B, O, a new label and,
    where rows have ``breaks``, by a newline between tokens. If n counts a document's tokens without gaps (``gapless``), a
    gap between tagged rows tells of an O, and only tagged rows are shuffled."""
    w = W.partitionBy("doc_id").orderBy("n")
    label = F.substring("tag", 3, 999)
    prev, apart = F.lag("tag").over(w), F.lit(False)
    if gapless:
        rows, apart = rows.where("tag != 'O'"), F.lag("n").over(w) != F.col("n") - 1
    fresh = (F.col("tag") != "O") & (F.startswith("tag", F.lit("B-")) | prev.isNull() | (prev == "O") | apart | (F.substring(prev, 3, 999) != label) | (F.col("breaks") if "breaks" in rows.columns else F.lit(False)))
    marked = rows.withColumn("label", label).withColumn("__f", fresh.cast("int")).withColumn("island", F.sum("__f").over(w)).where("tag != 'O'")
    return marked.groupBy("doc_id", "island", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def token_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """The first span (by start, end, label) that holds each token; hyphens in labels become underscores."""
    s = in_bins(spans.select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"), "label"), "a", "b")
    of = tokens.select("doc_id", "start", "end").distinct().withColumn("__bin", (F.col("start") / BIN).cast("int"))
    hit = of.join(s, ["doc_id", "__bin"]).where("a <= start AND end <= b")
    best = hit.groupBy("doc_id", "start", "end").agg(F.translate(F.min_by("label", F.struct("a", "b", "label")), "-", "_").alias("label"))
    return tokens.join(best, ["doc_id", "start", "end"], "left").select(*tokens.columns, "label")


def span_labels(tokens: Column, spans: Column) -> Column:
    """A22 within a document: for each token the label of the first span (by start, end, label) that holds it, hyphens as
    underscores, null if none does. A span's tokens are found by halving."""

    def of(tokens):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["label"].alias("label"))))

        def held(s, rank):
            place = F.struct(_first(tokens, lambda t: t["start"] >= s["a"]).alias("lo"), _first(tokens, lambda t: t["end"] > s["b"]).alias("hi"))
            rows = lambda p: F.transform(F.sequence(p["lo"], p["hi"] - 1), lambda i: F.struct(i.alias("i"), rank.alias("r"), F.translate(s["label"], "-", "_").alias("label")))
            return let(place, lambda p: F.when(p["lo"] < p["hi"], rows(p)).otherwise(F.array().cast("array<struct<i:int,r:int,label:string>>")))

        hits = F.array_sort(F.flatten(F.transform(ordered, held)))
        owned = let(hits, lambda h: F.filter(h, lambda x, k: (k == 0) | (F.get(h, k - 1)["i"] != x["i"])))
        none = lambda n: F.array_repeat(F.lit(None).cast("string"), n)
        last = lambda o, k: F.coalesce(F.when(k > 0, F.get(o, k - 1)["i"]), F.lit(-1))
        return let(owned, lambda o: F.concat(F.flatten(F.transform(o, lambda x, k: F.concat(none(x["i"] - 1 - last(o, k)), F.array(x["label"])))), none(F.size(tokens) - 1 - last(o, F.size(o)))))

    return let(tokens, of)


def merge_adjacent(docs: DataFrame, labels: tuple[str, ...] = ("NAME", "PATIENT")) -> DataFrame:
    """Spans of the same one of ``labels`` that exactly one blank separates become one."""
    from annolake.operators.resolve import by_place, runs

    def joins(a, b):
        return b["label"].isin(list(labels)) & (a["label"] == b["label"]) & (b["start"] == a["end"] + 1) & (surface(F.col("text"), a["end"], b["start"]) == " ")

    firsts = lambda x: F.transform(x, lambda s, i: F.when(F.coalesce(joins(F.get(x, i - 1), s), F.lit(False)), "0").otherwise("1"))
    return docs.withColumn("spans", runs(by_place(F.col("spans")), firsts, lambda own: own[0].withField("end", F.element_at(own, -1)["end"])).cast(SPANS))


def without_repeats(text: Column) -> Column:
    """Of equal words in a row, whatever their case, the first stays."""
    return F.regexp_replace(text, r"(?iU)\b(\w+)(?:\s+\1\b)+", "$1")


def token_confidence(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """A span's confidence is the mean of the tokens that it overlaps."""
    t = tokens.select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"), F.col("confidence").alias("c"))
    once = F.greatest((F.col("a") / BIN).cast("int"), (F.col("start") / BIN).cast("int")) == F.col("__bin")  # the first bin that both reach into
    hit = in_bins(spans.drop("confidence"), "start", "end").join(in_bins(t, "a", "b"), ["doc_id", "__bin"]).where("a < end AND b > start").where(once)
    return hit.groupBy("doc_id", "start", "end", "label").agg(F.avg("c").alias("confidence"))


# --------------------------------------------------------------------------- sentences

#: Words whose full stop ends no sentence.
ABBREVIATIONS = "dr mr mrs ms pt sr jr vs etc approx cf e.g i.e mg ml kg mcg mm cm hg st no dept hosp univ inc co am pm".split()


def sentences(text: Column) -> Column:
    """array<struct<start, end, text>>. A sentence ends before a blank line, or after . ! ? and closing marks when the
    text ends there, a newline follows, or after blanks an upper-case letter, a digit or a bullet. A full stop after an
    abbreviation or a single letter ends none. White space around sentences belongs to none.

    One regular expression matches a sentence: characters that don't end it, then what does.
    """
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS if "." not in a)
    abbreviated = rf"(?<![\p{{L}}])(?:(?:{short})|\p{{L}})\."
    closing = r"""[.!?"')\]]*"""
    end = rf"""[.!?]{closing}(?=[ \t]*(?:\z|\n|[\p{{Lu}}\d\-*•]))"""
    inner = rf"(?i:{abbreviated})|(?!\n\n)(?!{end})[\s\S]"
    # lookbehind at a sentence's beginning sees the sentence before, as white space or its end stands there
    return F.transform(matches(text, rf"(?U)(?=\S)(?:{inner})*+(?:{end})?"), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(F.regexp_replace(m["text"], r"(?U)\s+$", ""))).alias("end"), F.regexp_replace(m["text"], r"(?U)\s+$", "").alias("text")))


def by_sentence(docs: DataFrame) -> DataFrame:
    """A document for each sentence, {id}#s{i}, with the spans that it holds, clipped and moved."""
    each = docs.select("doc_id", "spans", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    inside = F.filter("spans", lambda x: (x["start"] < F.col("s.end")) & (F.col("s.start") < x["end"]))
    local = F.transform(inside, lambda x: x.withField("start", F.greatest(x["start"], F.col("s.start")) - F.col("s.start")).withField("end", F.least(x["end"], F.col("s.end")) - F.col("s.start")))
    return each.select(F.concat(F.col("doc_id").cast("string"), F.lit("#s"), F.col("i").cast("string")).alias("doc_id"), F.col("s.text").alias("text"), local.alias("spans"), F.col("doc_id").cast("string").alias("parent_doc_id"), F.col("s.start").alias("sentence_offset"), F.col("i").alias("sentence_index"))


def align_subwords(docs: DataFrame, encode, labels: list[str]) -> DataFrame:
    """(doc_id, input_ids, label_ids) of a tokenizer's pieces. ``encode``: texts -> [(ids, [(start, end)])]; pieces
    that go on a word (they begin where the last one ended) and special ones get -100, others the label of the longest
    span that covers them."""
    import pandas as pd

    number = {x: i for i, x in enumerate(labels)}

    def run(batches):
        for pdf in batches:
            out = []
            for doc, spans, (ids, places) in zip(pdf.doc_id, pdf.spans, encode(list(pdf.text))):
                row, last, inside = [], None, None
                for a, b in places:
                    if a == b or a == last:
                        row.append(-100)
                    else:
                        cover = [s for s in spans if s["start"] <= a and b <= s["end"]]
                        s = max(cover, key=lambda s: s["end"] - s["start"]) if cover else None
                        key = None if s is None else (s["start"], s["end"], s["label"])
                        row.append(number["O"] if s is None else number[("I-" if key == inside else "B-") + s["label"]])
                        inside = key
                    last = b if a != b else last
                out.append((doc, list(ids), row))
            yield pd.DataFrame(out, columns=["doc_id", "input_ids", "label_ids"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans").mapInPandas(run, "doc_id string, input_ids array<int>, label_ids array<int>")
