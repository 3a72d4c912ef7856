"""The automaton over terms against regular expressions, one term at a time."""

import random
import re
import time

import pytest

from annolake.functions.automaton import Terms, squeezed
from annolake.operators import detect
from annolake.schema import SPANS


def by_expression(text, terms):
    out = set()
    for i, (term, edges) in enumerate(terms):
        inner = r"\s+".join(re.escape(p) for p in term.split())
        if inner:
            out |= {(m.start(), m.end(), i) for m in re.finditer(rf"\b{inner}\b" if edges else inner, text, re.IGNORECASE)}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_hits_equal_expressions(seed):
    rng = random.Random(seed)
    bits = ["a", "b", "ab", "A", " ", "  ", "\n\t ", "-", "(", "é", "1", "_", "."]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        terms = [("".join(rng.choice(bits) for _ in range(rng.randint(1, 5))).strip(), rng.random() < 0.7) for _ in range(12)]
        assert set(Terms(terms).hits(text)) == by_expression(text, terms), (text, terms)


def test_places_of_squeezed_text_and_longer_lower_case():
    assert squeezed("a \n b\tc")[0] == "a b c"
    assert Terms([("x y", True)]).hits("İ  x \n\n y. X Y") == [(3, 9, 0), (11, 14, 0)]
    assert Terms([]).hits("abc") == [] and Terms([("a", True)]).hits(None) == []


def test_100000_terms_in_one_scan(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    terms = list({rng.choice([word(), f"{word()} {word()}", f"{word()}-{word()}", f"{word()}, {word()}", f"O'{word()}"]) for _ in range(100000)})
    texts = [" ".join(rng.choice(terms) if rng.random() < 0.3 else word() for _ in range(60)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame([(f"L{i % 3}", t) for i, t in enumerate(terms)], "label string, term string")
    start = time.time()
    df = detect.term_matches(docs, table)
    got = {tuple(r) for r in df.collect()}
    assert time.time() - start < 30
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    label = {}
    for i, t in enumerate(terms):
        label.setdefault(t.lower(), set()).add(f"L{i % 3}")
    # every run of up to 40 characters between word edges, looked up
    want = set()
    for d, text in enumerate(texts):
        edges = [i for i in range(len(text) + 1) if (i > 0 and re.match(r"\w", text[i - 1]) is not None) != (i < len(text) and re.match(r"\w", text[i]) is not None)]
        for a in edges:
            for b in edges:
                if a < b <= a + 40:
                    want |= {(d, a, b, x) for x in label.get(text[a:b].lower(), ())}
    # none of these terms overlaps itself
    assert got == want and len(got) > 500


def test_shards_give_the_same_hits(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "New  York, new york (NY) and O'Neil")], "doc_id int, text string")
    table = spark.createDataFrame([("CITY", "new york"), ("CITY", "York"), ("NAME", "O'Neil"), ("CODE", "NY"), ("X", " "), (None, "and")], "label string, term string")
    whole = sorted(map(tuple, detect.term_matches(docs, table).collect()))
    monkeypatch.setattr(detect, "SHARD_CHARS", 20)
    assert sorted(map(tuple, detect.term_matches(docs, table).collect())) == whole and len(whole) == 6


def test_blacklists_of_many_terms_and_spans(spark):
    n = 3000
    text = " ".join(f"w{i}" for i in range(n))
    at = [m.span() for m in re.finditer(r"\S+", text)]
    spans = [(a, b, "X", None, None) for a, b in at]
    docs = spark.createDataFrame([(1, text, spans), (2, None, []), (3, "", None)], f"doc_id int, text string, spans {SPANS}")
    terms = [f"W{i}" for i in range(0, 40000, 2)]
    for match in ("any_token", "whole_span", "overlap_document"):
        start = time.time()
        rows = {r.doc_id: r.spans for r in detect.blacklist(docs, terms, match).collect()}
        assert [s.start for s in rows[1]] == [a for i, (a, _) in enumerate(at) if i % 2], match
        assert time.time() - start < 20
    rows = {r.doc_id: r.spans for r in detect.blacklist(docs, ["9", "w1"], "substring").collect()}
    assert [s.start for s in rows[1]] == [a for a, b in at if "9" not in text[a:b] and "w1" not in text[a:b]]


def test_2000_seeds_in_a_long_document(spark):
    n = 2000
    names = [f"name{i:04d}" for i in range(n)]
    text = " ".join(names + names[::-1] + ["filler"] * 20000)
    spans = [(9 * i, 9 * i + 8, "NAME", 0.9, "m") for i in range(n)]
    docs = spark.createDataFrame([(1, text, spans)], f"doc_id int, text string, spans {SPANS}")
    start = time.time()
    (r,) = detect.propagate(docs).collect()
    assert len(r.spans) == 2 * n and time.time() - start < 15
    assert sorted((s.start, s.end) for s in r.spans) == sorted((i, i + 8) for i in range(0, 9 * 2 * n, 9))
    assert {s.confidence for s in r.spans} == {0.9}
