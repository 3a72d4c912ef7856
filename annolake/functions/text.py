"""Column functions on texts: match places, occurrences, white space, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,text:string>>"


#: Items whose places are summed up by one fold; longer lists are cut into runs of so many.
RUN = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters that no text should hold, which part matches and groups; texts that do hold one are searched without.
MARK, GROUP = "\ufdd0", "\ufdd1"


def searched(text: Column, pattern: str, groups: list[int]) -> Column:
    """array<struct<start, end, text, groups>>: leftmost non-overlapping matches of a Java regular expression, in code points,
    with the texts of ``groups`` (empty of those that took no part).

    One search writes marks around the matches and between their groups, and the text is cut there: the running sum of
    the pieces' lengths is where matches stand. Where the text holds such a mark itself, matches, the pieces between
    them and each group come from searches of their own. Empty matches can't be placed, so the pattern must not match
    the empty string.
    """
    item = lambda gap, hit, own: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), hit.alias("text"), own.alias("groups"))

    def cut(parts):
        def one(x, k):
            if not groups:
                return item(F.get(parts, 2 * k), x, F.array().cast("array<string>"))
            return let(F.split(x, GROUP, -1), lambda g: item(F.get(parts, 2 * k), F.get(g, 0), F.slice(g, 2, len(groups))))

        return F.transform(F.filter(parts, lambda x, i: i % 2 == 1), one)

    def apart(found):
        of = [F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) for n in groups]
        own = lambda own, gaps: F.transform(found, lambda x, k: item(F.get(gaps, k), x, F.transform(own, lambda o: F.get(o, k)) if groups else F.array().cast("array<string>")))
        return let(F.array(*of) if of else F.array().cast("array<array<string>>"), lambda o: let(F.split(text, pattern, -1), lambda gaps: own(o, gaps)))

    written = F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0" + "".join(f"{GROUP}${n}" for n in groups) + MARK))
    none = F.array().cast("array<struct<gap:int,hit:int,text:string,groups:array<string>>>")
    marked = let(F.split(written, MARK, -1), lambda parts: F.when(F.size(parts) > 1, cut(parts)).otherwise(none))
    plain = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, apart(found)).otherwise(none))
    items = F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(GROUP)), plain).otherwise(marked)
    placed = lambda x, start: F.struct(start.alias("start"), (start + x["hit"]).alias("end"), x["text"].alias("text"), x["groups"].alias("groups"))
    return let(items, lambda x: F.zip_with(x, running(x, lambda i: i["gap"], lambda i: i["hit"]), placed))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>>: ``searched`` without groups."""
    return F.transform(searched(text, pattern, []), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))


def running(items: Column, before, size) -> Column:
    """Where each of ``items`` starts if ``before(item)`` places come before it and it takes ``size(item)`` itself.

    A fold's state is copied at every step, so runs of RUN items are folded each for itself and then moved by what
    comes before them: time is linear in the items, but for a part too small to tell.
    """

    def fold(items, before, size):
        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc, x):
            start = acc["at"] + before(x)
            return F.struct((start + size(x)).alias("at"), F.concat(acc["out"], start.cast("string"), F.lit(" ")).alias("out"))

        return F.aggregate(items, state, step, lambda acc: F.struct(F.split(F.rtrim(acc["out"]), " ").cast("array<int>").alias("starts"), acc["at"].alias("n")))

    def in_runs(items):
        cut = F.transform(F.sequence(F.lit(0), (F.size(items) - 1).cast("int"), F.lit(RUN)), lambda i: fold(F.slice(items, i + 1, F.lit(RUN)), before, size))
        return let(cut, lambda runs: F.flatten(F.transform(F.arrays_zip(runs.alias("r"), fold(runs, lambda r: F.lit(0), lambda r: r["n"])["starts"].alias("at")), lambda x: F.transform(x["r"]["starts"], lambda s: s + x["at"]))))

    return let(items, lambda x: F.when(F.size(x) > RUN, in_runs(x)).when(F.size(x) > 0, fold(x, before, size)["starts"]).otherwise(F.array().cast("array<int>")))


def quote(term: str) -> str:
    """A regular expression for exactly ``term``."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~])", r"\\\1", term)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def token_count(text: Column) -> Column:
    """Runs of other than white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def surface(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Characters that two intervals share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def literal(needle: Column) -> Column:
    """A column's value as a regular expression for exactly itself."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def find_all(text: Column, needle: Column) -> Column:
    """Places of the leftmost non-overlapping occurrences of ``needle``; none of an empty one. The pieces between them
    are cut once, and their running length gives the places."""
    n = F.length(needle)
    gaps = F.transform(F.split(text, literal(needle), -1), F.length)
    scan = let(gaps, lambda g: running(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), lambda x: x, lambda x: n))
    return F.when((n > 0) & F.contains(text, needle), scan).otherwise(F.array().cast("array<int>"))


def count_all(text: Column, needle: Column) -> Column:
    """How often ``needle`` occurs, overlapping occurrences too."""
    hits = F.regexp_count(text, F.concat(F.lit("(?="), literal(needle), F.lit(")")))
    return F.when((F.length(needle) > 0) & F.contains(text, needle), hits).otherwise(F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))
