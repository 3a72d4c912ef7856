"""Operator 7: secret scans. Three fixed patterns, and tokens whose characters pass a battery of randomness tests under
false-discovery control by length. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.text import matches as places
from annolake.llm.common import cut

#: Kind, pattern, and what a match needs; kinds in their listed order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: HEX and CANDIDATE scan for what is long enough only: a possessive run has no other matches.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: A token's inferred encoding: the smallest alphabet that holds all its characters.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16),
    ("letters", r"^(?:[a-z]+|[A-Z]+)$", 26),
    ("base32", r"^(?:[a-z2-7]+|[A-Z2-7]+)$", 32),
    ("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 36),
    ("base62", r"^[A-Za-z0-9]+$", 62),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", 64),
)
#: Text changes its kind of character (lower, upper, digit, mark) in so great a part of all places at most.
TEXT_CHANGES = 0.08
#: Of two neighbouring letters of text one is a vowel, one not, in so great a part of all places at least; two letters of
#: it are equal with this chance; the sum of its letters' cubed shares.
TEXT_VOWEL_CHANGES, TEXT_EQUAL, TEXT_CUBES = 0.6, 0.07, 0.0065
#: A battery test rejects randomness below this two-sided tail (3.29 standard deviations).
BATTERY_Z = 3.29
FALSE_DISCOVERY = 0.01
P_BINS = 12


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: the leftmost non-overlapping matches with their code-point places, end exclusive."""
    return F.transform(places(text, pattern), lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["text"].alias("m")))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 of a standard normal, to 1e-7 (rational approximation 26.2.17 of Abramowitz and Stegun)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def battery(tokens: DataFrame, token: str = "m") -> DataFrame:
    """Adds encoding, alphabet, n, z_uniform, z_runs, z_serial, changes, p_text, random to rows with a token column.

    chi-squared: counts of the alphabet's characters against equal shares, as a standard normal. Runs: changes between
    kinds of character against what the alphabet's shares lead to. Serial correlation: of adjacent characters' places
    in the alphabet. ``random``: none of the three is off by more than BATTERY_Z on the side that text is (too uneven,
    too few changes, correlated). Letters of one case are of one kind, so that vowels and consonants are their kinds;
    text changes these too often. ``p_text``: the tail of text of this length for its changes of kind, equal letters
    and changes of vowel and consonant together, as far as the alphabet has them. Padding is not counted.
    """
    body = F.regexp_replace(token, "=+$", "")
    t = tokens.withColumn("body", body).withColumn("n", F.length("body"))
    enc, size = F.lit(None), F.lit(64)
    for name, rx, a in reversed(ENCODINGS):
        enc, size = F.when(F.col("body").rlike(rx), F.lit(name)).otherwise(enc), F.when(F.col("body").rlike(rx), F.lit(a)).otherwise(size)
    t = t.withColumn("encoding", enc).withColumn("alphabet", size.cast("double"))
    t = t.withColumn("chars", F.split("body", "")).withColumn("chars", F.filter("chars", lambda c: c != ""))
    code = lambda c: F.ascii(c)
    kind = lambda c: F.when(code(c).between(97, 122), 0).when(code(c).between(65, 90), 1).when(code(c).between(48, 57), 2).otherwise(3)
    place = lambda c: F.when(code(c).between(48, 57), code(c) - 48).when(code(c).between(97, 122), code(c) - 87).when(code(c).between(65, 90), code(c) - 29).otherwise(62)
    t = t.withColumn("kinds", F.transform("chars", kind)).withColumn("places", F.transform("chars", lambda c: place(c).cast("double")))
    # counts of equal characters: a sorted token falls into runs of equal ones
    ordered = F.array_join(F.array_sort("chars"), "")
    t = t.withColumn("squares", F.aggregate(F.regexp_extract_all(ordered, F.lit(r"((.)\2*)"), F.lit(1)), F.lit(0.0), lambda a, r: a + (F.length(r) * F.length(r)).cast("double")))
    n, a = F.col("n").cast("double"), F.col("alphabet")
    chi = F.col("squares") * a / n - n
    t = t.withColumn("z_uniform", (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n)))
    pairs = lambda col: F.arrays_zip(F.slice(col, 1, F.size(col) - 1).alias("x"), F.slice(col, 2, F.size(col) - 1).alias("y"))
    t = t.withColumn("changes", F.size(F.filter(pairs("kinds"), lambda p: p["x"] != p["y"])))
    # shares of the kinds in the alphabet: hex 6/16 letters; letters 5/26 vowels; base32 26/32; base36 26/36; base62 and base64 26, 26, 10 and marks
    letters_only = a == 26
    same = F.when(a == 16, (6 * 6 + 10 * 10) / 256).when(letters_only, (5 * 5 + 21 * 21) / 26**2).when(a == 32, (26 * 26 + 6 * 6) / 1024).when(a == 36, (26 * 26 + 10 * 10) / 36**2).when(a == 62, (26 * 26 * 2 + 100) / 62**2).otherwise((26 * 26 * 2 + 100 + 4) / 64**2)
    m = n - 1
    # vowels 1, other letters 0, all else null
    vowel = lambda c: F.when(F.lower(c).isin(*"aeiou"), 1).when(c.rlike("[A-Za-z]"), 0)
    t = t.withColumn("vowels", F.transform("chars", vowel)).withColumn("beside", F.filter(pairs("vowels"), lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    t = t.withColumn("vowel_changes", F.size(F.filter("beside", lambda p: p["x"] != p["y"])))
    t = t.withColumn("z_runs", (F.when(letters_only, F.col("vowel_changes")).otherwise(F.col("changes")) - m * (1 - same)) / F.sqrt(m * same * (1 - same)))
    mean = F.aggregate("places", F.lit(0.0), lambda s, x: s + x) / n
    t = t.withColumn("mean", mean)
    t = t.withColumn("var", F.aggregate("places", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))))
    t = t.withColumn("cov", F.aggregate(pairs("places"), F.lit(0.0), lambda s, p: s + (p["x"] - F.col("mean")) * (p["y"] - F.col("mean"))))
    t = t.withColumn("z_serial", F.when(F.col("var") > 0, F.col("cov") / F.col("var") * F.sqrt(n)).otherwise(F.sqrt(n)))
    zt = (F.col("changes") - 0.5 - m * TEXT_CHANGES) / F.sqrt(m * TEXT_CHANGES * (1 - TEXT_CHANGES))
    # how far the letters, in one case, are from text: fewer equal ones, fewer changes of vowel and consonant
    only = F.lower(F.regexp_replace("body", "[^A-Za-z]", ""))
    runs_of = F.regexp_extract_all(F.array_join(F.array_sort(F.split(only, "")), ""), F.lit(r"((.)\2*)"), F.lit(1))
    equal = F.aggregate(runs_of, F.lit(0.0), lambda s, r: s + (F.length(r) * (F.length(r) - 1)).cast("double"))
    k, mb = F.length(only).cast("double"), F.size("beside").cast("double")
    ze = (TEXT_EQUAL - equal / (k * (k - 1))) / F.sqrt(2 * TEXT_EQUAL * (1 - TEXT_EQUAL) / (k * (k - 1)) + 4 * (TEXT_CUBES - TEXT_EQUAL**2) / k)
    zv = (mb * TEXT_VOWEL_CHANGES - F.col("vowel_changes") - 0.5) / F.sqrt(mb * TEXT_VOWEL_CHANGES * (1 - TEXT_VOWEL_CHANGES))
    parts = F.array(F.when(~letters_only, zt), F.when((a != 16) & (k >= 8), ze), F.when((a != 16) & (mb >= 4), zv))
    known = F.filter(parts, lambda z: z.isNotNull())
    z = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size(known))
    t = t.withColumn("z_text", z).withColumn("p_text", F.when(F.col("z_text") > 0, _normal_tail(F.col("z_text"))).otherwise(1.0))
    off_runs = F.when(letters_only, F.col("z_runs") < BATTERY_Z).otherwise(F.col("z_runs") > -BATTERY_Z)
    t = t.withColumn("random", (F.col("z_uniform") < BATTERY_Z) & off_runs & (F.abs("z_serial") < BATTERY_Z))
    return t.drop("body", "chars", "kinds", "places", "squares", "mean", "var", "cov", "vowels", "beside", "vowel_changes", "z_text")


def length_class(n: Column) -> Column:
    return F.when(n < 20, 0).when(n < 24, 1).when(n < 32, 2).when(n < 48, 3).otherwise(4)


def discoveries(tested: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """(length_class, p_most): Benjamini-Hochberg within each class of length over all tokens of that class.

    p-values count in bins of a power of ten each, so the sorted list is never gathered: a bin's upper edge is allowed
    if it is at most rate * (tokens up to it) / (tokens of the class). Short tokens are many and change little by
    chance, so their class asks for smaller p-values.
    """
    p_bin = F.least(F.lit(P_BINS), F.floor(-F.log10(F.greatest(F.col("p_text"), F.lit(1e-300))))).cast("int")
    counts = tested.groupBy(length_class(F.col("n")).alias("length_class"), p_bin.alias("p_bin")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy("length_class").orderBy(F.desc("p_bin")))
    total = F.sum("k").over(W.partitionBy("length_class"))
    return counts.withColumn("edge", F.pow(F.lit(10.0), -F.col("p_bin"))).withColumn("upto", upto).withColumn("total", total).where(F.col("edge") <= rate * F.col("upto") / F.col("total")).groupBy("length_class").agg(F.max("edge").alias("p_most"))


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """(doc_id, base, random) for every row of ``docs`` (doc_id, text): arrays of struct<s, e, k, kind>, by start, then
    kind as listed.

    Base spans are the fixed patterns' matches in the whole text, each kind by itself. Tokens that touch none of them
    are tested; those whose battery finds them random and whose p-value is within the bound of their length are added.
    Texts without a long token are not split at all. Null and empty texts have no spans; repeated rows are scanned
    each for itself, a token counting once for each time that it occurs; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    span = lambda arr, k: F.transform(arr, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(KINDS[k]).alias("kind"), x["m"].alias("m")))
    at = lambda need, rx, ok: F.when(need, F.filter(matches(text, rx), ok)).otherwise(_none())
    has_assign = text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"' :=]")
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6
    d = docs.select("doc_id", text.alias("text"))
    text = F.col("text")
    d = d.withColumn("a", span(at(has_assign, ASSIGN, value), 0))
    d = d.withColumn("c", span(at(F.contains(text, F.lit("AKIA")), ACCESS, lambda x: F.length(x["m"]) >= 20), 1))
    d = d.withColumn("h", span(at(text.rlike(HEX_LONG), HEX_LONG, lambda x: F.length(x["m"]) >= 24), 2))
    d = d.withColumn("r", span(at(text.rlike(CANDIDATE), CANDIDATE, lambda x: F.length(x["m"]) >= 16), 3))
    d = d.withColumn("base", F.array_sort(F.concat("a", "c", "h")))
    d = d.withColumn("r", F.filter("r", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    # each row is a document of its own: its number rides along only to bring accepted tokens back to it
    found = cut(d.select("doc_id", F.transform("base", lambda x: x.dropFields("m")).alias("base"), "r").withColumn("row", F.expr("uuid()")))
    tested = battery(found.select("row", F.explode("r").alias("x")).select("row", "x", F.col("x.m").alias("m")))
    bounds = discoveries(tested, rate)
    good = tested.where("random").withColumn("length_class", length_class(F.col("n"))).join(F.broadcast(bounds), "length_class").where("p_text <= p_most")
    per_row = good.groupBy("row").agg(F.array_sort(F.collect_list(F.col("x").dropFields("m"))).alias("random"))
    some, none = found.where(F.size("r") > 0).join(per_row, "row", "left"), found.where(F.size("r") == 0).withColumn("random", F.filter("base", lambda x: F.lit(False)))
    return some.unionByName(none).select("doc_id", "base", F.coalesce("random", F.filter("base", lambda x: F.lit(False))).alias("random"))


# --------------------------------------------------------------------------- query


def op7_secrets(spark, sf_dir):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; n_random counts the battery's spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    joined = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
