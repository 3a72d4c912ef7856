"""Places of a pattern's groups against Python's, which knows them."""

import re

import pytest

from annolake.functions.groups import parse, pieces
from annolake.functions.packs import PATTERNS
from annolake.operators import detect

CASES = [
    (r"(?:foo\s+)(\d+)(?=bar)|x(\d)", ["foo 12bar", "x7 foo 1bar", "foo 12"]),
    (r"a(b)|c(?<=xc)(d)", ["xcd", "cd ab", "xcd ab xcd"]),
    (r"12 (\d+) 12", ["12 12 12", "12 1 12 99"]),
    (r"(?:No|Nr\.?(?:\s(a|b)\s)?)\s*(\d+)", ["No 5, Nr. a 77", "Nr b 1"]),
    (r"(ab)+(c)?", ["ababc", "ab abab", "c"]),
    (r"(ab)+c", ["ababc abc"]),
    (r"(\w)\1-(\d)", ["aa-1 ab-2 bb-3"]),
    (r"[()|\]](x)\(|\((y)\)", ["]x( (y) |x("]),
    (r"(?:q(\d),)+", ["q1,q2,q3,"]),
    (r"(?<name>\d+)kg", ["5kg 70kg"]),
    (r"none", ["none at all"]),
    (r"\Q(a)\E(b)", ["(a)b"]),
]


def by_python(pattern, text):
    out = []
    for m in re.finditer(pattern.replace("(?<name>", "(?P<name>").replace(r"\Q(a)\E", r"\(a\)"), text):
        g = next((i for i in range(1, (m.re.groups or 0) + 1) if m[i]), 0)
        out.append(m.span(g))
    return out


@pytest.mark.parametrize("pattern,texts", CASES)
def test_groups_stand_where_the_search_found_them(spark, pattern, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = detect.regex_ner(df, {"X": [pattern]}, dedupe=False, flags="").collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows} == {i: by_python(pattern, t) for i, t in enumerate(texts)}


def test_written_patterns_capture_all_before_their_groups():
    p = pieces(r"(?i)a(?:b|c(d))e(f)")
    assert p.pattern == r"(?i)(a)(?:(b)|(c)(d))(e)(f)" and p.entities == [(4, [1, 2, 3]), (6, [1, 2, 3, 4, 5])]
    with pytest.raises(ValueError):
        parse("(a")


def test_packs_find_what_python_finds(spark):
    texts = [
        "Tel no: 416-555-0199 x12. Call (416) 555-0100 or phone: 416 555 0199 ext 5, fax# +1 416 555 0100.",
        "MRN: 12-345 MRN number 9912, patient id ABC-12, NPI 1234567890; DEA # AB1234567. OHIP: 1234-567-890-AB SIN 123-456-789",
        "aged 57, a 60-year-old, 33 y/o; since 1999, in 2001 and by 1987. Jan 5, 2020; 5th of March, 2019; winter of 2018",
        "Ontario, Ohio 44101-1234 and California 90210, K1A 0B1. 12 Main Street, apt 4; P.O. Box 12; VIN: 1HGCM82633A004352",
        "s/n ABC-1234 license: D123-456 device id XK-99 UDI: (01)12345678 hospital no 77123",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for label, alternatives in PATTERNS.items():
        rows = detect.regex_ner(df, {label: alternatives}, dedupe=False).collect()
        want = {i: by_python("(?i)" + "|".join(alternatives), t) for i, t in enumerate(texts)}
        assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows} == want, label
