"""Searching texts for any number of literal terms in one pass: an automaton over all terms, with word edges."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<start:int,end:int,term:int>>"
SPACES = re.compile(r"\s{2,}")
ANY_SPACE = re.compile(r"\s")


def lowered(text: str) -> str:
    """Lower case, character by character: the few characters whose lower case is longer stay, so that places do."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def squeezed(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """``text`` with each run of white space as one blank, where runs of more than one were, and how many characters have
    been left out up to each of them."""
    at, out, n = [], [], 0
    for m in SPACES.finditer(text):
        at.append(m.start() - n + 1)
        n += m.end() - m.start() - 1
        out.append(n)
    return ANY_SPACE.sub(" ", SPACES.sub(" ", text)), np.array(at, np.int64), np.array(out, np.int64)


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


def edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    return (at > 0 and word(text[at - 1])) != (at < len(text) and word(text[at]))


class Terms:
    """An automaton over terms (term, whether it must stand between word edges). Case does not count unless
    ``case_sensitive``; white space within a term is any white space unless ``raw``. With ``edges_after`` a term's
    occurrences are made non-overlapping before edges count, so one without edges takes the place of one behind it."""

    def __init__(self, terms: Iterable[tuple[str, bool]], case_sensitive: bool = False, raw: bool = False, edges_after: bool = False):
        self.fold = (lambda t: t) if case_sensitive else lowered
        self.raw, self.edges_after = raw, edges_after
        self.found = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, (term, edges) in enumerate(terms):
            text = self.fold(term) if raw else " ".join(self.fold(term).split())
            if text:
                by_text.setdefault(text, []).append((i, edges))
        for text, kinds in by_text.items():
            self.found.add_word(text, (len(text), tuple(kinds)))
        self.empty = not by_text
        if by_text:
            self.found.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, number of the term): of each term its leftmost non-overlapping occurrences, by end."""
        if not text or self.empty:
            return []
        low = self.fold(text)
        at = left_out = None
        if not self.raw:
            low, at, left_out = squeezed(low)
        out, free = [], {}
        for last, (n, kinds) in self.found.iter(low):
            start, end = last + 1 - n, last + 1
            between = None
            for i, edges in kinds:
                if edges and between is None:
                    between = edge(low, start) and edge(low, end)
                if (between or not edges or self.edges_after) and start >= free.get(i, 0):
                    free[i] = end
                    if between or not edges:
                        out.append((start, end, i))
        if at is not None and len(at) and out:
            places = np.array([(s, e) for s, e, _ in out])
            # a place moves by what was left out before it; an end just behind a run's blank lies behind the run
            moved = places + np.concatenate([[0], left_out])[np.searchsorted(at, places, "right")]
            out = [(int(s), int(e), i) for (s, e), (_, _, i) in zip(moved, out)]
        return out


def term_hits(text: Column, terms: list[tuple[str, bool, str]], case_sensitive: bool = False, raw: bool = False, edges_after: bool = False) -> Column:
    """array<struct<start, end, label>>: hits of all terms (term, word edges, label), each once, by start, end and label.
    The automaton is built once in each task, and each text is searched once, however many terms there are."""

    labels = sorted({label for _, _, label in terms})
    rank = {label: i for i, label in enumerate(labels)}
    of = [rank[label] for _, _, label in terms]

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Terms([(t, edges) for t, edges, _ in terms], case_sensitive, raw, edges_after)
        for texts in batches:
            # one text at a time as a string; hits as three whole numbers each
            offsets, places = np.zeros(len(texts) + 1, np.int32), array("i")
            for row, t in enumerate(texts, 1):
                for hit in sorted({(s, e, of[i]) for s, e, i in index.hits(t.as_py())}):
                    places.extend(hit)
                offsets[row] = len(places) // 3
            start, end, label = np.frombuffer(places, np.int32).reshape(-1, 3).T if places else np.zeros((3, 0), np.int32)
            names = pa.array(labels, pa.string()).take(pa.array(label))
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start.copy()), pa.array(end.copy()), names], ["start", "end", "label"]))

    return F.arrow_udf(search, "array<struct<start:int,end:int,label:string>>")(text)


def hit_inside(text: Column, starts: Column, ends: Column, terms: list[str]) -> Column:
    """array<boolean>: for each range of ``starts`` and ``ends`` whether a term, in any case, stands in it."""

    def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        index = Terms([(t, False) for t in terms], raw=True)
        # a term's own leftmost occurrences may reach over a range's begin, so every occurrence counts
        for texts, firsts, lasts in batches:
            rows = []
            for t, a, b in zip(texts, firsts, lasts):
                found = [] if index.empty or not t or a is None or not len(a) else sorted((last + 1 - n, last + 1) for last, (n, _) in index.found.iter(index.fold(t)))
                if not found:
                    rows.append([False] * (0 if a is None else len(a)))
                    continue
                s, e = np.array(found).T
                nearest = np.append(np.minimum.accumulate(e[::-1])[::-1], np.iinfo(np.int64).max)  # the least end from each start on
                rows.append((nearest[np.searchsorted(s, a)] <= np.asarray(b)).tolist())
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(search, "array<boolean>")(text, starts, ends)


def seed_occurrences(text: Column, seeds: Column, labels: Column, starts: Column, ends: Column, have: Column, case_sensitive: bool) -> Column:
    """array<struct<start, end, term>>: leftmost non-overlapping literal occurrences of each of a document's own ``seeds``,
    ``term`` being the seed's place; of seeds equal in text and label the first counts. Ranges of (``starts``, ``ends``)
    that ``have`` the seed's label already are left out. One automaton for each document, one pass over its text."""

    def search(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        fold = (lambda t: t) if case_sensitive else lowered
        for columns in batches:
            out = []
            for t, own, names, a, b, old in zip(*columns):
                by_text: dict[str, dict[str, int]] = {}
                for i, (s, label) in enumerate(zip(own, names)) if own is not None else ():
                    if s:
                        by_text.setdefault(fold(s), {}).setdefault(label, i)
                index = Terms([(s, False) for s in by_text], case_sensitive, raw=True)
                taken, kinds = set(zip(a, b, old)) if a is not None else set(), list(by_text.values())
                out.append([{"start": s, "end": e, "term": i} for s, e, k in index.hits(t) for label, i in kinds[k].items() if (s, e, label) not in taken])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(search, HITS)(text, seeds, labels, starts, ends, have)
