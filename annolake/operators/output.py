"""Text from spans: redaction, aligned surrogates, leakage."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.packs import SURROGATE_PACKS
from annolake.functions.text import count_all, let, matches, ratio, running, surface
from annolake.operators.resolve import by_place, for_replacement
from annolake.schema import SPANS


def replaced(text: Column, ordered: Column, new) -> Column:
    """struct<text, spans>: the text with each span replaced by ``new(span)`` and the spans where they then stand.

    ``ordered`` spans must not overlap. Their new values are computed once; running lengths of these and of the texts
    between give the new places.
    """

    def put(x, values):
        before = lambda s, i: s["start"] - F.coalesce(F.get(x, i - 1)["end"], F.lit(0))
        sizes = F.transform(x, lambda s, i: F.struct(before(s, i).alias("gap"), F.length(F.get(values, i)).alias("n")))
        parts = F.transform(x, lambda s, i: F.concat(surface(text, s["start"] - before(s, i), s["start"]), F.get(values, i)))
        tail = F.substring(text, F.coalesce(F.get(x, F.size(x) - 1)["end"], F.lit(0)) + 1, F.length(text))
        moved = let(running(sizes, lambda z: z["gap"], lambda z: z["n"]), lambda at: F.transform(x, lambda s, i: s.withField("start", F.get(at, i)).withField("end", F.get(at, i) + F.length(F.get(values, i)))))
        return F.struct(F.concat(F.array_join(parts, ""), tail).alias("text"), moved.cast(SPANS).alias("spans"))

    return let(ordered, lambda x: let(F.transform(x, new), lambda values: put(x, values)))


def redact(text: Column, spans: Column) -> Column:
    """[LABEL] for each span, the longest of overlapping ones."""
    return replaced(text, for_replacement(spans), lambda s: F.concat(F.lit("["), s["label"], F.lit("]")))["text"]


def overlapping(spans: Column) -> Column:
    """Whether any two spans overlap."""
    ordered = by_place(spans)
    return F.aggregate(ordered, F.struct(F.lit(0).alias("end"), F.lit(False).alias("bad")), lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["bad"] | (s["start"] < acc["end"])).alias("bad")))["bad"]


# --------------------------------------------------------------------------- surrogates
# Values are picked by a hash of seed, label and original, so that a pair gives the same surrogate on any executor.

#: Names are made of syllables, so that different originals have different ones: 80**7 full names, 80**5 single ones.
SYLLABLES = [c + v for c in "bdfghjklmnprstvz" for v in "aeiou"]
ROADS = "Oak Maple Cedar Elm Birch Walnut Chestnut Willow".split()
COUNTRIES = "Canada France Germany Japan Kenya Norway Peru Spain".split()
STATES = "Ohio Texas Maine Utah Iowa Oregon Nevada Vermont".split()


def _hash(seed: int, label: Column, original: Column, salt: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), F.upper(label), original, F.lit(salt))


def _pick(values: list[str], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def _name(h: Column, n: int) -> Column:
    """A name of n syllables, one of 80**n."""
    number = F.pmod(h, F.lit(len(SYLLABLES) ** n))
    return let(number, lambda x: F.initcap(F.concat(*[F.element_at(F.array(*[F.lit(s) for s in SYLLABLES]), (F.pmod(F.floor(x / F.lit(len(SYLLABLES) ** i)).cast("long"), F.lit(len(SYLLABLES))) + 1).cast("int")) for i in range(n)])))


def _digits(h: Column, n: int) -> Column:
    return F.lpad(F.pmod(h, F.lit(10**n)).cast("string"), n, "0")


def permuted(digits: Column, *keys: Column) -> Column:
    """Digits (4 to 18 of them) as others of the same number, different ones for different ones: a keyed permutation. Each
    half is moved, in turns, by a hash of the other, which can be undone."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    half = lambda width: F.pow(F.lit(10.0), width).cast("long")
    state = F.struct(F.substring(digits, F.lit(1), left).cast("long").alias("a"), F.substring(digits, left + 1, n).cast("long").alias("b"))

    def turn(x, i):
        b = F.pmod(x["b"] + F.pmod(F.xxhash64(*keys, n, i, F.lit("b"), x["a"]), half(n - left)), half(n - left))
        return let(b, lambda b: F.struct(F.pmod(x["a"] + F.pmod(F.xxhash64(*keys, n, i, F.lit("a"), b), half(left)), half(left)).alias("a"), b.alias("b")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, turn)
    return let(done, lambda x: F.concat(F.lpad(x["a"].cast("string"), left, "0"), F.lpad(x["b"].cast("string"), n - left, "0")))


def surrogate(label: Column, original: Column, seed: int = 42, pack="clinical_phi") -> Column:
    """A stand-in by the label's strategy; asterisks where it has none. Forms follow the original: two
    words give two names, dates keep / or -, ids their length (four digits at least). Numbers of 4 to 18 digits are
    permuted, so that different ones of a label never share a stand-in; names and addresses of mail are of so many forms
    that a million different ones share none, to be expected."""
    strategy = SURROGATE_PACKS[pack] if isinstance(pack, str) else pack
    h = lambda i=0: _hash(seed, label, original, i)
    words = F.regexp_count(original, F.lit(r"\S+"))
    upper = original.rlike(r"(?U)^\p{Lu}")
    name = F.when(words >= 2, F.concat_ws(" ", _name(h(1), 3), _name(h(2), 4))).when(upper, _name(h(1), 5)).otherwise(_name(h(2), 5))
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(h(), F.lit(3650)).cast("int"))
    date = F.when(F.contains(original, F.lit("/")), F.date_format(day, "MM/dd/yyyy")).when(F.contains(original, F.lit("-")), F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MMM dd, yyyy"))
    n = F.greatest(F.length(original), F.lit(4))
    hashed = F.substring(F.repeat(_digits(h(3), 18), (n / 18 + 1).cast("int")), 1, n)
    number = F.when(original.rlike("^[0-9]{4,18}$"), permuted(original, F.lit(seed), F.upper(label))).otherwise(hashed)
    kinds = {
        "Name": name,
        "Date": date,
        "Phone": F.concat(F.lit("("), _digits(h(4), 3), F.lit(") 555-"), _digits(h(5), 4)),
        "Email": F.concat(F.lower(_name(h(1), 3)), F.lit("."), F.lower(_name(h(2), 4)), F.lit("@example.org")),
        "ID": number,
        "Address": F.concat_ws(" ", (F.pmod(h(6), F.lit(9000)) + 100).cast("string"), _pick(ROADS, h(7)), F.lit("Street")),
        "Postal Code": _digits(h(8), 5),
        "Organization": F.concat_ws(" ", _name(h(9), 4), F.lit("Group")),
        "Age": (F.pmod(h(10), F.lit(70)) + 20).cast("string"),
        "Country": _pick(COUNTRIES, h(11)),
        "State": _pick(STATES, h(12)),
        "URL": F.concat(F.lit("https://"), F.lower(_name(h(13), 4)), F.lit(".example.org/")),
    }
    out = F.repeat(F.lit("*"), F.length(original))
    for kind, value in kinds.items():
        of = [k for k, v in strategy.items() if v == kind]
        if of:
            out = F.when(F.upper(label).isin(of), value).otherwise(out)
    return out


def with_surrogates(docs: DataFrame, seed: int = 42, pack="clinical_phi", on_overlap: str = "raise") -> DataFrame:
    """output_text and output_spans, the spans where the surrogates stand. Overlapping spans raise, or with
    ``on_overlap='drop'`` the longest stay."""
    text = F.col("text")
    spans = by_place(F.col("spans")) if on_overlap == "raise" else for_replacement(F.col("spans"))
    out = replaced(text, spans, lambda s: surrogate(s["label"], surface(text, s["start"], s["end"]), seed, pack))
    if on_overlap == "raise":
        out = F.when(overlapping(F.col("spans")), F.raise_error(F.concat(F.lit("overlapping spans in document "), F.col("doc_id").cast("string")))).otherwise(out)
    return docs.withColumn("__out", out).withColumn("output_text", F.col("__out.text")).withColumn("output_spans", F.col("__out.spans")).drop("__out")


def rendered(docs: DataFrame, mode: str = "redacted", **options) -> DataFrame:
    """output_text by mode: annotated (as it was), redacted, or surrogate."""
    if mode == "annotated":
        return docs.withColumn("output_text", F.col("text"))
    if mode == "redacted":
        return docs.withColumn("output_text", redact(F.col("text"), F.col("spans")))
    if mode == "surrogate":
        return with_surrogates(docs, **options)
    raise ValueError(f"unknown output mode {mode!r}")


# --------------------------------------------------------------------------- placeholders of clinical notes

MONTHS = "january february march april may june july august september october november december".split()
#: What a placeholder says in lower case, as regular expressions in the order in which they are tried, the
#: kind that it then is, and that kind's label; kinds without a label are removed.
PLACEHOLDER_RULES = (
    (r"first", "first name", "NAME"),
    (r"last", "last name", "NAME"),
    (r"phone|fax|telephone", "phone number", "PHONE"),
    (r"pager", "pager number", "PHONE"),
    (r"e-mail|email", "e-mail", "EMAIL"),
    (r"url", "url", "URL"),
    (r"social security", "social security number", "ID"),
    (r"md number|medical license", "medical license number", "ID"),
    (r"job number", "job id", "ID"),
    (r"medical record number|mrn", "medical record number", "ID"),
    (r"unit number", "unit number", "ID"),
    (r"serial number", "serial number", "ID"),
    (r"clip number", "clip number", "ID"),
    (r"numeric identifier", "numeric id", "ID"),
    (r"hospital ward", "hospital ward", "HOSPITAL"),
    (r"hospital unit", "hospital unit", "HOSPITAL"),
    (r"hospital", "hospital", "HOSPITAL"),
    (r"university|college", "university", "ORGANIZATION"),
    (r"company", "company", "ORGANIZATION"),
    (r"apartment address", "apartment address", "LOCATION"),
    (r"street address", "street address", "LOCATION"),
    (r"po box", "po box", "LOCATION"),
    (r"location", "location", "LOCATION"),
    (r"country", "country", "COUNTRY"),
    (r"state", "state", "STATE"),
    (r"date range", "date range", "DATE"),
    (r"month \(only\)", "month only", "DATE"),
    (r"month/day/year", "full date", "DATE"),
    (r"month/day", "month day", "DATE"),
    (r"month/year", "month year", "DATE"),
    (r"month day", "month day alpha", "DATE"),
    (r"day month", "day month alpha", "DATE"),
    (r"month year", "month year alpha", "DATE"),
    (r"year month", "year month alpha", "DATE"),
    (r"(?s)(?=.*\b\d{4}\b).*(?:" + "|".join(MONTHS) + ")", "month year", "DATE"),
    ("|".join(MONTHS), "month only", "DATE"),
    (r"^\d{4}-\d{1,2}-\d{1,2}\b", "full date", "DATE"),
    (r"^\d{1,2}-\d{1,2}$", "month day", "DATE"),
    (r"^\d{1,2}/\d{4}$", "month year", "DATE"),
    (r"(?s)(?=.*90).*age", "age over 90", "AGE"),
    (r"age|^\d{1,2}$", "age", "AGE"),
    (r"year|^(?:19|20|21|22)\d\d$", "year", "DATE"),
    (r"name", "full name", "NAME"),
    (r"dictator info", "dictator info", "NAME"),
    (r"attending info", "attending info", "NAME"),
    (r"cc contact info", "cc contact info", "NAME"),
    (r"holiday", "holiday", "DATE"),
    (r"^\d{3,}$|number|id", "numeric id", "ID"),
    (r"^\d[\d/.-]*\d$", "full date", "DATE"),
    (r"^$", "blank", None),
)


def placeholder_kind(content: Column) -> Column:
    """What a [** **] placeholder stands for, ``other`` if no rule fits."""
    said = F.lower(F.trim(content))
    out = F.lit("other")
    for pattern, kind, _ in reversed(PLACEHOLDER_RULES):
        out = F.when(said.rlike(pattern), kind).otherwise(out)
    return out


def placeholder_label(content: Column) -> Column:
    """The label of a [** **] placeholder, null for none."""
    labels = F.create_map(*[F.lit(x) for kind, label in {k: v for _, k, v in PLACEHOLDER_RULES}.items() if label for x in (kind, label)])
    return F.get(F.transform(F.array(placeholder_kind(content)), lambda kind: F.try_element_at(labels, kind)), F.lit(0))


def fill_placeholders(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Placeholders become surrogates under spans; unknown ones vanish without one; then newlines become blanks."""
    text = F.col("text")
    found = F.transform(matches(text, r"\[\*\*[^*]+\*\*\]"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), placeholder_label(F.substring(m["text"], 4, F.length(m["text"]) - 6)).alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("placeholder").alias("source"))).cast(SPANS)
    out = replaced(text, found, lambda s: F.when(s["label"].isNull(), "").otherwise(surrogate(s["label"], F.concat(F.col("doc_id").cast("string"), surface(text, s["start"], s["end"])), seed)))
    done = docs.withColumn("__out", out)
    return done.withColumn("text", F.translate("__out.text", "\n\r", "  ")).withColumn("spans", F.filter("__out.spans", lambda s: s["label"].isNotNull())).drop("__out")


#: Surface forms of names in notes, and how many of a hundred names have each.
NAME_FORMS = (("full_title", 45), ("last_only", 20), ("title_last", 15), ("initial_title", 12), ("full_lower", 8))
TITLES = ("Dr.", "Mr.", "Ms.", "Mrs.")


def made_up_name(key: Column, seed: int = 42) -> Column:
    """struct<form, name>: a name in one of the surface forms, picked by the hash of ``key``."""
    h = lambda i: F.xxhash64(F.lit(seed), key, F.lit(i))
    first, last = _name(h(1), 3), _name(h(2), 4)
    draw, form, upto = F.pmod(h(3), F.lit(100)), F.lit(NAME_FORMS[-1][0]), 100
    for name, share in reversed(NAME_FORMS):
        form, upto = F.when(draw < upto, name).otherwise(form), upto - share
    as_said = lambda f: F.when(f == "full_title", F.concat_ws(" ", first, last)).when(f == "last_only", last).when(f == "title_last", F.concat_ws(" ", _pick(list(TITLES), h(4)), last)).when(f == "initial_title", F.concat(F.substring(first, 1, 1), F.lit(". "), last)).otherwise(F.lower(F.concat_ws(" ", first, last)))
    return F.struct(form.alias("form"), as_said(form).alias("name"))


def identity(docs: DataFrame, seed: int = 42) -> DataFrame:
    """A made-up name, record number and age (normal around 62 with deviation 18, 1 to 89) for each document."""
    h = lambda i: F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.lit(i))
    unit = lambda i: (F.pmod(h(i), F.lit(1_000_000)) + 1) / 1_000_001
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))
    return docs.withColumn("person", F.concat_ws(" ", _name(h(3), 3), _name(h(4), 4))).withColumn("record_number", _digits(h(5), 7)).withColumn("age", F.least(F.lit(89), F.greatest(F.lit(1), (62 + 18 * normal).cast("int"))))


# --------------------------------------------------------------------------- leakage


def leakage(docs: DataFrame) -> DataFrame:
    """H9: (doc_id, label, surface, gold_count, leaked_count) of documents with text, spans (gold) and output_text:
    occurrences in the output whatever the case, overlapping ones too, up to as many as there were."""
    rows = docs.select("doc_id", "text", "output_text", F.explode("spans").alias("s"))
    said = rows.select("doc_id", F.col("s.label").alias("label"), surface(F.col("text"), F.col("s.start"), F.col("s.end")).alias("surface"))
    counts = said.where(F.trim(F.regexp_replace("surface", r"(?U)\s+", "")) != "").groupBy("doc_id", "label", "surface").agg(F.count("*").alias("gold_count"))
    hits = count_all(F.lower("output_text"), F.lower("surface"))
    return counts.join(docs.select("doc_id", "output_text"), "doc_id").select("doc_id", "label", "surface", "gold_count", F.least(F.col("gold_count"), hits).cast("long").alias("leaked_count"))


def leakage_by_label(docs: DataFrame) -> DataFrame:
    """Counts and rate by label over all documents."""
    return leakage(docs).groupBy("label").agg(F.sum("gold_count").alias("gold_count"), F.sum("leaked_count").alias("leaked_count")).withColumn("leakage_rate", ratio(F.col("leaked_count"), F.col("gold_count")))


def over_redaction(text: Column, output: Column, spans: Column) -> Column:
    """Characters outside spans that a sequence match finds deleted or replaced. Sequence matching has no
    built-in form; batches go through Arrow."""
    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for old, new, spans in zip(a, b, s):
            inside = {i for x in spans for i in range(max(0, x["start"]), min(x["end"], len(old or "")))}
            codes = difflib.SequenceMatcher(a=old or "", b=new or "", autojunk=False).get_opcodes()
            out.append(sum(i not in inside for tag, i1, i2, _, _ in codes if tag in ("delete", "replace") for i in range(i1, i2)))
        return pd.Series(out)

    return count(text, output, spans)
