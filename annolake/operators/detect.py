"""Operators that produce or drop spans by scanning texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.automaton import hit_inside, seed_occurrences, term_hits
from annolake.functions.groups import pieces
from annolake.functions.packs import ENTITY_LABELS, MODEL_ENTITIES, PATTERN_PACKS
from annolake.functions.starts import condition
from annolake.functions.text import find_all, let, matches, quote, searched, squeeze, surface
from annolake.operators.resolve import by_place, flags, halved, halvings, longest, overlaps, runs
from annolake.schema import SPANS, certain, documents, exploded, no_spans

#: Characters of the terms of one automaton, 8 more counted for each term.
SHARD_CHARS = 4_000_000


def pattern_spans(text: Column, alternatives: list[str], label: str, source: str, flags: str = "(?iU)") -> Column:
    """Matches of the alternatives, the first that fits a place winning, narrowed to the first group that took part and holds
    a character. A group's text and place come from the search that found the match."""
    found = pieces("|".join(alternatives))
    first = condition(alternatives, flags)
    pattern = flags + (f"{first}(?:{found.pattern})" if first else found.pattern)
    spans = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.lit(label).alias("label"), F.lit(1.0).alias("confidence"), F.lit(source).alias("source"))
    if not found.entities:
        return F.transform(matches(text, pattern), lambda m: spans(m["start"], m["end"])).cast(SPANS)
    needed = sorted({n for g, before in found.entities for n in [g, *map(abs, before or [])]})

    def one(m):
        part = lambda n: F.get(m["groups"], needed.index(n))
        place = F.struct(m["start"].alias("start"), m["end"].alias("end"))
        for g, before in reversed(found.entities):
            if before is None:  # repeated within another group: the last place in the match that reads so
                offset = F.length(m["text"]) - F.length(part(g)) - F.instr(F.reverse(m["text"]), F.reverse(part(g))) + 1
            else:
                offset = sum((F.length(part(n)) if n > 0 else -F.length(part(-n)) for n in before), F.lit(0))
            here = F.struct((m["start"] + offset).alias("start"), (m["start"] + offset + F.length(part(g))).alias("end"))
            place = F.when(F.length(part(g)) > 0, here).otherwise(place)
        return let(place, lambda p: spans(p["start"], p["end"]))

    return F.transform(searched(text, pattern, needed), one).cast(SPANS)


def accumulate(docs: DataFrame, new: Column, skip_overlapping: bool = False) -> DataFrame:
    """A document's spans and new ones, by start, end, label; new ones that overlap an old one may be left out."""
    if skip_overlapping:
        new = F.filter(new, lambda s: ~F.exists("spans", lambda o: overlaps(o, s)))
    return docs.withColumn("spans", by_place(F.concat("spans", new)))


def regex_ner(docs: DataFrame, pack="clinical_phi", labels: dict | None = None, dedupe: bool = True, skip_overlapping: bool = False, source: str = "regex_ner", flags: str = "(?iU)") -> DataFrame:
    """Spans of a pattern pack. ``labels``: label -> dict(enabled, remap, pattern); one that the pack lacks
    needs a pattern. With ``dedupe`` the new spans are made non-overlapping first, longest first."""
    patterns = dict(PATTERN_PACKS[pack]) if isinstance(pack, str) else dict(pack)
    remap = {}
    for label, how in (labels or {}).items():
        if not how.get("enabled", True):
            patterns.pop(label, None)
            continue
        if how.get("pattern"):
            patterns[label] = [how["pattern"]]
        if how.get("remap"):
            remap[label] = how["remap"]
    found = [pattern_spans(F.col("text"), [patterns[x]] if isinstance(patterns[x], str) else patterns[x], remap.get(x, x), source, flags) for x in sorted(patterns)]
    new = F.concat(*found) if found else no_spans()
    docs = documents(docs).withColumn("__new", new)
    return accumulate(docs, longest(F.col("__new")) if dedupe else F.col("__new"), skip_overlapping).drop("__new")


def placeholders(text: Column) -> Column:
    """What stands in [** **], with its place."""
    return F.transform(matches(text, r"\[\*\*[^*]+\*\*\]"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substring(m["text"], 4, F.length(m["text"]) - 6).alias("content")))


# --------------------------------------------------------------------------- dictionaries


def tokens_with_places(docs: DataFrame, pattern: str = r"(?U)\w+") -> DataFrame:
    """(doc_id, n, start, end, token) of each match."""
    return exploded(docs, ["doc_id"], matches(F.col("text"), pattern), "n", "m").select("doc_id", "n", "m.start", "m.end", F.col("m.text").alias("token"))


def term_matches(docs: DataFrame, terms: DataFrame, case_sensitive: bool = False, edges_after: bool = False) -> DataFrame:
    """(doc_id, start, end, label): hits of (label, term) between word edges, white space in terms being any white space;
    of each term the leftmost non-overlapping ones, or with ``edges_after`` those of its leftmost non-overlapping
    occurrences that stand between word edges.

    Terms may hold anything: words, phrases, punctuation. An automaton over all terms passes over each text once; terms
    of more than SHARD_CHARS characters are dealt over several passes, each with an automaton of its own.
    """
    t = terms.select("label", squeeze(F.col("term")).alias("term")).where("term != '' AND label IS NOT NULL").distinct()
    shards = max(1, -(-t.agg(F.coalesce(F.sum(F.length("term") + 8), F.lit(0))).first()[0] // SHARD_CHARS))
    out = None
    for k in range(shards):
        own = t.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == k) if shards > 1 else t
        hits = term_hits(F.col("text"), sorted((r["term"], True, r["label"]) for r in own.collect()), case_sensitive, edges_after=edges_after)
        found = exploded(docs.select("doc_id", "text"), ["doc_id"], hits, "n", "m").select("doc_id", "m.start", "m.end", "m.label")
        out = found if out is None else out.unionByName(found)
    return out.distinct() if shards > 1 else out


def literal_matches(text: Column, terms: list[str], word_edges: bool = True) -> Column:
    """Hits of a short list of literal terms, white space in them being any white space, leftmost and longest first."""
    parts = [r"\s+".join(quote(p) for p in t.split()) for t in sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))]
    return matches(text, "(?iU)" + "|".join(rf"\b{p}\b" if word_edges else p for p in parts)) if parts else F.array().cast("array<struct<start:int,end:int,text:string>>")


def whitelist(docs: DataFrame, terms: dict[str, list[str]], skip_overlapping: bool = False, source: str = "whitelist") -> DataFrame:
    """Spans of whole-word, case-insensitive hits of each label's terms, each (start, end, label) once."""
    every = sorted({(t.strip().lower(), True, label) for label in terms for t in terms[label] if t.strip()})
    hits = F.transform(term_hits(F.col("text"), every), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label"), F.lit(1.0).alias("confidence"), F.lit(source).alias("source")))
    docs = documents(docs).withColumn("__new", hits.cast(SPANS) if every else no_spans())
    return accumulate(docs, F.col("__new"), skip_overlapping).drop("__new")


def blacklist_regions(text: Column, terms: list[str], patterns: list[str] = ()) -> Column:
    """array<struct<start, end>>: hits of terms (one word: between word edges) and patterns, merged if they touch."""
    place = lambda m: F.transform(m, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    found = term_hits(text, [(t, len(t.split()) == 1, "") for t in sorted(set(terms)) if t.strip()])
    raw = F.concat(place(found), *[place(matches(text, "(?iU)" + p)) for p in patterns])
    begin = {"reach": F.lit(-1)}
    step = lambda acc, x: (x["start"] > acc["reach"], {"reach": F.greatest(acc["reach"], x["end"])})
    one = lambda own: F.struct(own[0]["start"].alias("start"), F.array_max(F.transform(own, lambda x: x["end"])).alias("end"))
    return runs(F.array_sort(raw), lambda x: flags(x, begin, step), one).cast("array<struct<start:int,end:int>>")


def blacklist(docs: DataFrame, terms: list[str], match: str = "any_token", patterns: list[str] = (), labels: list[str] | None = None) -> DataFrame:
    """Drops spans that hit a term: any word of the span, the whole span, a part of it, or a region of
    the document that it overlaps. ``labels``: spans of other labels stay."""
    match = {"exact_span": "whole_span"}.get(match, match)
    upper = sorted({t.strip().upper() for t in terms if t.strip()})
    text = F.col("text")
    said = lambda s: surface(text, s["start"], s["end"])
    if match == "overlap_document":
        # regions are disjoint and in order: the last that begins before a span's end reaches farthest
        docs = docs.withColumn("__regions", blacklist_regions(text, terms, patterns)).withColumn("__powers", halvings(F.size("__regions")))
        last = lambda s: F.get("__regions", halved(F.col("__regions"), F.size("__regions"), F.col("__powers"), lambda r: r["start"] < s["end"]) - 1)
        hit = lambda s, i: let(last(s), lambda r: F.coalesce(r["end"] > s["start"], F.lit(False)))
    elif match == "whole_span":
        hit = lambda s, i: F.upper(squeeze(said(s))).isin(upper)
    elif match == "substring":
        docs = docs.withColumn("__hit", hit_inside(text, F.transform("spans", lambda s: s["start"]), F.transform("spans", lambda s: s["end"]), upper))
        hit = lambda s, i: F.get("__hit", i)
    elif match == "any_token":
        hit = lambda s, i: F.exists(F.regexp_extract_all(said(s), F.lit(r"(?U)\w+"), F.lit(0)), lambda t: F.upper(t).isin(upper))
    else:
        raise ValueError(f"unknown match {match!r}")
    scope = (lambda s: s["label"].isin(list(labels))) if labels else (lambda s: F.lit(True))
    return docs.withColumn("spans", F.filter("spans", lambda s, i: ~(scope(s) & hit(s, i)))).drop("__regions", "__powers", "__hit")


def propagate(docs: DataFrame, min_confidence: float = 0.0, labels: list[str] | None = None, case_sensitive: bool = True, source: str = "consistency_propagator") -> DataFrame:
    """Every literal, non-overlapping occurrence of a trusted span's surface becomes a span of its label, unless
    that range has the label already. Seeds of the same surface and label count once, the first in the array; the
    result is by start and end, old spans before new ones."""
    trusted = lambda s: (certain(s) >= min_confidence) & (s["label"].isin(list(labels)) if labels else F.lit(True))
    of = lambda spans, field: F.transform(spans, lambda s: s[field])
    docs = docs.withColumn("__seeds", F.filter("spans", trusted))
    said = F.transform("__seeds", lambda s: surface(F.col("text"), s["start"], s["end"]))
    hits = seed_occurrences(F.col("text"), said, of("__seeds", "label"), of("spans", "start"), of("spans", "end"), of("spans", "label"), case_sensitive)
    docs = docs.withColumn("__hits", hits)
    seed = lambda h: F.get("__seeds", h["term"])
    new = F.transform("__hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), seed(h)["label"].alias("label"), seed(h)["confidence"].alias("confidence"), F.lit(source).alias("source")))
    ordered = F.transform(F.array_sort(F.transform(F.concat("spans", new.cast(SPANS)), lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))), lambda r: r["s"])
    return docs.withColumn("spans", ordered).drop("__seeds", "__hits")


# --------------------------------------------------------------------------- model detectors


def windows(n_tokens: Column, max_tokens: int, specials: int = 2, overlap: int = 64) -> Column:
    """array<struct<start, end>> of token windows of max_tokens - specials - 2, each ``overlap`` before the last's end."""
    size = max_tokens - specials - 2
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0)), F.lit(step))
    kept = F.filter(starts, lambda s: (s == 0) | (s + overlap < n_tokens))
    return F.transform(kept, lambda s: F.struct(s.alias("start"), F.least(s + size, n_tokens).alias("end")))


def _detector(make_detector, fail_open: bool):
    """struct<spans, error> for each text: a batch that raises is tried again text by text, so that one bad text takes
    none of its neighbours with it."""

    def one(detector, text):
        try:
            return detector([text])[0], None
        except Exception as e:
            if not fail_open:
                raise
            return [], f"{type(e).__name__}: {e}"

    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for texts in batches:
            try:
                found = [(spans, None) for spans in detector(list(texts))]
            except Exception:
                if not fail_open:
                    raise
                found = [one(detector, t) for t in texts]
            spans = [[{"start": a, "end": b, "label": x, "confidence": c, "source": o} for a, b, x, c, o in spans if 0 <= a < b <= len(t)] for t, (spans, _) in zip(texts, found)]
            yield pd.DataFrame({"spans": pd.Series(spans, dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return detect


def external(docs: DataFrame, make_detector, mapping: dict | None = None, fail_open: bool = True, skip_overlapping: bool = False, error: str | None = None) -> DataFrame:
    """Spans of any detector. ``make_detector`` builds, once in each worker, a function from texts to
    lists of (start, end, label, confidence, source); spans out of range are dropped and labels mapped. With
    ``fail_open`` a document that it raises on keeps its spans, and the column ``error``, if one is named, says why."""
    found = F.pandas_udf(_detector(make_detector, fail_open), f"spans {SPANS}, error string")(F.coalesce("text", F.lit("")))
    docs = documents(docs).withColumn("__found", found).withColumn("__new", F.col("__found.spans"))
    if error:
        docs = docs.withColumn(error, F.col("__found.error"))
    if mapping:
        from annolake.operators.labels import mapped

        docs = docs.withColumn("__new", mapped(F.col("__new"), mapping))
    return accumulate(docs, F.col("__new"), skip_overlapping).drop("__new", "__found")


def analyzer_mapping(entities: dict | None = None, models: dict | None = None) -> dict[str, str]:
    """Model label -> span label, by way of what the analyzer calls it; own maps replace the built-in ones."""
    entities, models = ENTITY_LABELS if entities is None else entities, MODEL_ENTITIES if models is None else models
    return {k: entities.get(v, v) for k, v in models.items()} | {k: v for k, v in entities.items() if k not in models}


def label_space(model_labels: list[str], entities: dict | None = None, models: dict | None = None, built_in: tuple[str, ...] = ()) -> list[str]:
    """The labels that a detector can give: those of its model, and ``built_in`` entities of the analyzer itself."""
    entities, models = ENTITY_LABELS if entities is None else entities, MODEL_ENTITIES if models is None else models
    return sorted({entities.get(e, e) for e in [models.get(x, x) for x in model_labels] + list(built_in)})


def manifest_space(manifest: dict, entity_map: dict | None = None, label_mapping: dict | None = None) -> list[str]:
    """The labels of a model's manifest, by its default_entity_map, ``entity_map`` over it, then ``label_mapping``,
    in which null drops a label."""
    known = (manifest.get("default_entity_map") or {}) | (entity_map or {})
    found = {known.get(x, x) for x in manifest.get("labels") or []}
    return sorted({y for x in found if (y := (label_mapping or {}).get(x, x)) is not None})


def segmentation(requested: str, trained: str | None = None) -> str:
    """What is asked for; ``auto`` means sentences for models trained on them, else chunks."""
    return requested if requested != "auto" else "sentence" if trained == "sentence" else "chunk"


def whitelist_settings(labels: dict | None = None, per_label: dict | None = None, label_mapping: dict | None = None) -> dict[str, dict]:
    """Label -> dict(enabled, remap, terms, dictionaries) from present and older settings. Older terms and
    dictionaries join the present ones; an older mapping renames labels that have no remap, and to null switches off."""
    blank = lambda x: {"enabled": True, "remap": None, "terms": [], "dictionaries": []} | (x or {})
    out = {k: blank(v) for k, v in (labels or {}).items()}
    for label, old in (per_label or {}).items():
        old = blank(old)
        both = {k: sorted({*out[label][k], *old[k]}) for k in ("terms", "dictionaries")} if label in out else old
        out[label] = out.get(label, {}) | both
    for label, target in (label_mapping or {}).items():
        if label in out:
            out[label] |= {"enabled": False} if target is None else {"remap": out[label]["remap"] or target}
    return out


def whitelist_of(docs: DataFrame, settings: dict[str, dict], dictionaries: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """D5 by the settings of whitelist_settings; ``dictionaries``: terms of the named lists."""
    terms: dict[str, list[str]] = {}
    for label, s in settings.items():
        if s["enabled"]:
            own = [*s["terms"], *(t for d in s["dictionaries"] for t in (dictionaries or {}).get(d, ()))]
            terms.setdefault(s["remap"] or label, []).extend(own)
    return whitelist(docs, terms, **options)


def llm_items(raw: Column) -> Column:
    """The first JSON list, or object, of a model's answer, fences stripped; null if there is none."""
    body = F.regexp_replace(raw, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1")
    found = F.regexp_extract(body, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when(found != "", found)


def locate_strings(text: Column, items: Column) -> Column:
    """Spans of array<struct<text, label>>: longest string first, all occurrences that overlap none taken yet."""
    ordered = F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct((-F.length(x["text"])).alias("n"), i.alias("i"), x.alias("x")))), lambda r: r["x"])
    each = F.flatten(F.transform(ordered, lambda x: F.transform(find_all(text, x["text"]), lambda p: F.struct(p.alias("start"), (p + F.length(x["text"])).alias("end"), x["label"].alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("llm_ner").alias("source"))))).cast(SPANS)
    from annolake.operators.resolve import _greedy

    return by_place(_greedy(each))


def llm_spans(text: Column, answer: Column, labels: list[str]) -> Column:
    """Spans of a model's JSON list, as its first item is: strings are located, offsets are taken if they are valid."""
    items = F.from_json(answer, "array<struct<text:string,start:int,end:int,label:string,confidence:double>>")
    first = F.get(items, 0)
    known = F.filter(items, lambda x: x["label"].isin(labels) & (F.length(x["text"]) > 0))
    located = locate_strings(text, F.transform(known, lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))))
    offsets = F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["confidence"].alias("confidence"), F.lit("llm_ner").alias("source")))
    return F.coalesce(F.when(first["text"].isNotNull(), located).when(first["start"].isNotNull() & first["end"].isNotNull(), by_place(valid_llm_spans(offsets.cast(SPANS), text, labels))), no_spans())


def valid_llm_spans(spans: Column, text: Column, labels: list[str]) -> Column:
    """Whole offsets within the text, and an allowed label."""
    return F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & s["label"].isin(labels))
