"""Span operators against plain Python on random spans, and the traps of their semantics."""

import random

import pytest
from pyspark.sql import functions as F

from annolake.functions.packs import LABEL_SPACES, PATTERN_PACKS, RISK_PROFILES, LabelSpace
from annolake.functions.text import count_all, find_all, matches
from annolake.operators import analytics, compare, corpus, detect, evaluate, labels, output, resolve, tagging
from annolake.schema import SPANS, checked, flat, invalid_spans, nested

DOC = f"doc_id long, text string, spans {SPANS}"


def make(spark, rows):
    return spark.createDataFrame([(i, t, [dict(start=s[0], end=s[1], label=s[2], confidence=s[3] if len(s) > 3 else None, source=s[4] if len(s) > 4 else None) for s in spans]) for i, t, spans in rows], DOC)


def random_docs(n=60, seed=1, labels="ABC"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choice("ab cde\U0001f600é\n") for _ in range(60))
        spans = []
        for _ in range(rng.randint(0, 9)):
            a = rng.randrange(59)
            spans.append((a, min(60, a + rng.randint(1, 12)), rng.choice(labels), rng.choice([None, 0.2, 0.5, 0.9]), rng.choice(["x", "y", None])))
        out.append((i, text, spans))
    return out


def spans_of(df):
    return {r.doc_id: [(s.start, s.end, s.label) for s in r.spans] for r in df.collect()}


def hit(a, b):
    return a[0] < b[1] and b[0] < a[1]


def greedy(spans, key, clash=hit):
    kept = []
    for s in sorted(spans, key=key):
        if not any(clash(s, k) for k in kept):
            kept.append(s)
    return sorted(s[:3] for s in kept)


RANK = {x: i for i, x in enumerate("BCA")}
KEYS = {
    resolve.longest: lambda s: s[0] - s[1],
    resolve.max_confidence: lambda s: -(1.0 if s[3] is None else s[3]),
    resolve.left_to_right: lambda s: (s[0], s[0] - s[1]),
    resolve.drop_overlapping: lambda s: (s[0], s[1]),
    resolve.for_replacement: lambda s: (s[0] - s[1], s[0], s[2]),
    resolve.leftmost_shortest: lambda s: (s[0], s[1] - s[0]),
    resolve.longest_leftmost: lambda s: (s[0] - s[1], s[0]),
}


@pytest.mark.parametrize("f", KEYS, ids=lambda f: f.__name__)
def test_greedy_strategies(spark, f):
    rows = random_docs()
    got = spans_of(resolve.resolve(make(spark, rows).repartition(5), f))
    assert got == {i: greedy(s, KEYS[f]) for i, _, s in rows}


def test_label_priority_and_unknown_strategy(spark):
    rows = random_docs()
    got = spans_of(resolve.resolve(make(spark, rows), "label_priority", ranking=["B", "C"]))
    assert got == {i: greedy(s, lambda x: (RANK[x[2]], x[0] - x[1], x[0])) for i, _, s in rows}
    with pytest.raises(ValueError):
        resolve.resolve(make(spark, rows), "best")


def test_reconcile_joins_over_one_character(spark):
    rows = random_docs(seed=4)
    want = {}
    for i, _, spans in rows:
        out = []
        for s in sorted(spans, key=lambda s: (s[2], s[0], s[1])):
            if out and out[-1][2] == s[2] and s[0] <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], s[1]), s[2])
            else:
                out.append(s[:3])
        want[i] = sorted(out)
    assert spans_of(resolve.resolve(make(spark, rows), resolve.reconcile)) == want
    one = make(spark, [(1, "John Smith", [(0, 4, "NAME", 0.5), (5, 10, "NAME")])])
    s = resolve.resolve(one, resolve.reconcile).first().spans[0]
    assert (s.start, s.end, s.confidence) == (0, 10, 1.0)


def test_consensus(spark):
    rows = random_docs(seed=5)
    assert all(not v for v in spans_of(resolve.resolve(make(spark, rows), "consensus")).values())
    want = {}
    for i, _, spans in rows:
        kept = [s for s in spans if len({o[4] or "" for o in spans if o[2] == s[2] and hit(o, s)}) >= 2]
        want[i] = greedy(kept, lambda s: (s[0], s[0] - s[1]), lambda a, b: a[2] == b[2] and hit(a, b))
    assert spans_of(resolve.resolve(make(spark, rows), "consensus", groups="source")) == want


def test_exact_dedupe_keeps_the_first(spark):
    d = make(spark, [(1, "abcdef", [(0, 2, "A", 0.1), (1, 3, "A", 0.2), (0, 2, "A", 0.9), (0, 2, "B", 0.3)])])
    assert [(s.start, s.label, s.confidence) for s in resolve.resolve(d).first().spans] == [(0, "A", 0.1), (0, "B", 0.3), (1, "A", 0.2)]


def test_overlap_groups_and_segments(spark):
    d = make(spark, [(1, "x" * 20, [(0, 5, "A"), (4, 8, "B"), (8, 10, "C"), (12, 14, "A")]), (2, "", [])])
    assert [(r.start, r.end, r.n) for r in resolve.overlap_groups(flat(d)).collect()] == [(0, 8, 2)]
    got = sorted((r.start, r.end, r.kind) for r in resolve.coverage_segments(d).collect())
    assert got == [(0, 4, "span"), (4, 5, "overlap"), (5, 8, "span"), (8, 10, "span"), (10, 12, "plain"), (12, 14, "span"), (14, 20, "plain")]


# --------------------------------------------------------------------------- detectors


@pytest.mark.parametrize(
    "text, label, said",
    [
        ("mail a.b@x.example.com now", "EMAIL", "a.b@x.example.com"),
        ("a.b [at] x [dot] org", "EMAIL", "a.b [at] x [dot] org"),
        ("Phone 4086569015 x12", "PHONE", "4086569015"),
        ("call (555) 123-4567", "PHONE", "(555) 123-4567"),
        ("on 2020-01-02 ok", "DATE", "2020-01-02"),
        ("since 1999 she", "DATE", "1999"),
        ("aged 55", "AGE", "55"),
        ("55-year-old", "AGE", "55-year-old"),
        ("MRN: A12345", "ID", "A12345"),
        ("License plate ABC1234", "ID", "ABC1234"),
        ("DEA # AB1234567", "ID", "AB1234567"),
        ("123-45-6789", "SSN", "123-45-6789"),
        ("see https://x.org/a)", "URL", "https://x.org/a"),
        ("ip 10.0.0.255.", "IP_ADDRESS", "10.0.0.255"),
        ("at Mercy General Hospital today", "ORGANIZATION", "Mercy General Hospital"),
        ("Illinois 60601-1234", "POSTAL_CODE", "60601-1234"),
        ("K1A 0B1", "POSTAL_CODE", "K1A 0B1"),
        ("12 Main Street, Apt 4", "ADDRESS", "12 Main Street, Apt 4"),
        ("😀 éé 14:30 pm", "DATE_TIME", "14:30 pm"),
    ],
)
def test_clinical_patterns(spark, text, label, said):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = detect.regex_ner(d, {label: PATTERN_PACKS["clinical_phi"][label]}).first().spans
    assert said in [text[s.start : s.end] for s in got]


def test_ssn_needs_the_same_separator(spark):
    d = spark.createDataFrame([(1, "123-45 6789 123456789")], "doc_id long, text string")
    assert [(s.start, s.end) for s in detect.regex_ner(d, {"SSN": PATTERN_PACKS["clinical_phi"]["SSN"]}).first().spans] == [(12, 21)]


def test_regex_options(spark):
    d = spark.createDataFrame([(1, "x 12 y")], "doc_id long, text string")
    spans = detect.regex_ner(d, {"N": [r"\d+"], "M": ["x"]}, {"N": {"remap": "ID"}, "M": {"enabled": False}, "Y": {"pattern": "Y"}}).first().spans
    assert [(s.start, s.end, s.label) for s in spans] == [(2, 4, "ID"), (5, 6, "Y")]
    with pytest.raises(KeyError):
        detect.regex_ner(d, "no such pack")


def test_whitelist_and_terms_agree(spark):
    text = "New  York and new york; Yorkshire, YORK"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("CITY", "New York"), ("CITY", "york"), ("CITY", " York ")], "label string, term string")
    a = sorted((s.start, s.end, s.label) for r in detect.whitelist(d, {"CITY": ["New York", "york", " York "]}).collect() for s in r.spans or [])
    b = sorted((r.start, r.end, r.label) for r in detect.term_matches(d.where("doc_id = 1"), terms).collect())
    assert a == b == [(0, 9, "CITY"), (5, 9, "CITY"), (14, 22, "CITY"), (18, 22, "CITY"), (35, 39, "CITY")]


def test_blacklist_modes(spark):
    d = make(spark, [(1, "Dr  Who said no thing", [(0, 7, "A"), (8, 12, "A"), (13, 15, "B"), (16, 21, "A")])])
    left = lambda **k: spans_of(detect.blacklist(d, **k))[1]
    assert (0, 7, "A") not in left(terms=["who"], match="any_token") and (0, 7, "A") not in left(terms=["dr who"], match="whole_span")
    assert (0, 7, "A") in left(terms=["dr  who"], match="whole_span")  # terms aren't squeezed, surfaces are
    assert (0, 7, "A") in left(terms=["dr who"], match="any_token")  # a word is never two
    assert left(terms=["hi"], match="substring") == [(0, 7, "A"), (8, 12, "A"), (13, 15, "B")]
    assert left(terms=["no"], match="overlap_document", labels=["B"]) == [(0, 7, "A"), (8, 12, "A"), (16, 21, "A")]
    with pytest.raises(ValueError):
        detect.blacklist(d, ["x"], "other")


def test_propagate(spark):
    d = make(spark, [(1, "Ann met ann. Ann, Anna", [(0, 3, "NAME", 0.9), (8, 11, "X", 0.1)])])
    assert spans_of(detect.propagate(d, 0.5))[1] == [(0, 3, "NAME"), (8, 11, "X"), (13, 16, "NAME"), (18, 21, "NAME")]
    assert (8, 11, "NAME") in spans_of(detect.propagate(d, 0.5, case_sensitive=False))[1]


def test_llm_answers(spark):
    d = spark.createDataFrame([("so ```json\n[{\"a\": 1}]\n``` end",), ("none",), ('x {"b": 2} y',)], "raw string")
    assert [r[0] for r in d.select(detect.llm_items(F.col("raw"))).collect()] == ['[{"a": 1}]', None, '{"b": 2}']
    t = spark.createDataFrame([("New York York", [("York", "B"), ("New York", "A")])], "text string, items array<struct<text:string,label:string>>")
    assert [(s.start, s.end, s.label) for s in t.select(detect.locate_strings(F.col("text"), F.col("items")).alias("s")).first().s] == [(0, 8, "A"), (9, 13, "B")]


def test_external_detector_fails_open(spark):
    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string")

    def broken():
        def run(texts):
            raise RuntimeError("no model")

        return run

    assert detect.external(d, broken).first().spans == []
    ranges = lambda: lambda texts: [[(0, 2, "A", 0.5, "m"), (2, 9, "A", 0.5, "m"), (2, 2, "A", None, "m")] for _ in texts]
    assert [(s.start, s.end, s.label) for s in detect.external(d, ranges, {"A": "B"}).first().spans] == [(0, 2, "B")]


def test_windows(spark):
    d = spark.createDataFrame([(0,), (10,), (300,)], "n int").select(detect.windows(F.col("n"), 104, 2, 20).alias("w"))
    got = [[(w.start, w.end) for w in r.w] for r in d.collect()]
    assert got[1] == [(0, 10)] and got[2] == [(0, 100), (80, 180), (160, 260), (240, 300)]


def test_match_places_with_any_characters(spark):
    t = "\u0001a\U0001f600bb\u0001a"
    d = spark.createDataFrame([(t, "a"), ("aaaa", "aa"), ("", "a"), ("x.y", "."), ("a\\Eb", "\\E")], "t string, n string")
    got = d.select(matches(F.col("t"), "a|b+").alias("m"), find_all(F.col("t"), F.col("n")).alias("f"), count_all(F.col("t"), F.col("n")).alias("c")).collect()
    assert [(m.start, m.end) for m in got[0].m] == [(1, 2), (3, 5), (6, 7)]
    assert [r.f for r in got] == [[1, 6], [0, 2], [], [1], [1]] and [r.c for r in got] == [2, 3, 0, 1, 1]


# --------------------------------------------------------------------------- labels


def test_label_operators(spark):
    d = make(spark, [(1, "abcdef", [(0, 1, "A"), (1, 2, "B"), (2, 3, "C")])])
    assert spans_of(labels.filter_labels(d, drop=["A"]))[1] == [(1, 2, "B"), (2, 3, "C")]
    with pytest.raises(ValueError):
        labels.filter_labels(d, ["A"], ["B"])
    assert spans_of(labels.map_labels(d, {"A": "X", "B": None}))[1] == [(0, 1, "X"), (2, 3, "C")]
    assert spans_of(labels.map_labels(d, {"A": "X", "B": None}, True))[1] == [(0, 1, "X")]
    assert spans_of(labels.map_labels(d, {"A": None}))[1] == [(1, 2, "B"), (2, 3, "C")]
    raw = spark.createDataFrame([("phone-number",), ("Zip Code",), ("dob",), ("who",)], "x string")
    assert [r[0] for r in raw.select(labels.normalise(F.col("x"))).collect()] == ["PHONE", "ZIP_CODE", "DATE", "OTHER"]
    with pytest.raises(ValueError):
        LabelSpace("x", ("A",), {}, "B")
    with pytest.raises(KeyError, match="clinical_phi"):
        LABEL_SPACES["none"]


def test_span_checks(spark):
    d = make(spark, [(1, "abc", [(0, 4, "A")]), (2, "abc", [(2, 2, "A")]), (3, "abc", [(0, 3, "A")])])
    assert sorted(r.doc_id for r in invalid_spans(d).collect()) == [1, 2]
    with pytest.raises(Exception, match="document 1|document 2"):
        checked(d).collect()
    assert spans_of(nested(d, flat(d))) == spans_of(d)


# --------------------------------------------------------------------------- evaluation


def sides(spark, seed=2):
    p, g = random_docs(seed=seed), random_docs(seed=seed + 50)
    return flat(make(spark, p)), flat(make(spark, g)), p, g


def counts(df):
    r = df.first()
    return (r.tp, r.fp, r.fn)


def test_strict_and_boundary_are_sets(spark):
    pred, gold, p, g = sides(spark)
    for f, cut in ((evaluate.strict, 3), (evaluate.boundary, 2)):
        a, b = ({(i, *s[:cut]) for i, _, spans in x for s in spans} for x in (p, g))
        assert counts(f(pred, gold)) == (len(a & b), len(a - b), len(b - a))


def test_partial_is_ordered_and_one_to_one(spark):
    pred, gold, p, g = sides(spark, 7)
    tp = fp = fn = part = 0
    for (_, _, ps), (_, _, gs) in zip(p, g):
        used, n = set(), 0
        for s in ps:
            best, most = None, 0
            for i, o in enumerate(gs):
                w = min(s[1], o[1]) - max(s[0], o[0])
                if i not in used and s[2] == o[2] and w > most:
                    best, most = i, w
            if best is not None:
                used.add(best)
                n += 1
                part += gs[best][:2] != s[:2]
        tp, fp, fn = tp + n, fp + len(ps) - n, fn + len(gs) - len(used)
    r = evaluate.partial(pred, gold).first()
    assert (r.tp, r.fp, r.fn, r.partial) == (tp, fp, fn, part)


def test_characters_count_wrong_tags_twice(spark):
    pred, gold, p, g = sides(spark, 9)

    def tags(spans):
        t = ["O"] * 60
        for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
            for i in range(s[0], s[1]):
                if t[i] == "O":
                    t[i] = ("B-" if i == s[0] else "I-") + s[2]
        return t

    tp = fp = fn = 0
    for (_, _, ps), (_, _, gs) in zip(p, g):
        for a, b in zip(tags(ps), tags(gs)):
            tp += a == b != "O"
            fp += a != "O" and a != b
            fn += b != "O" and a != b
    assert counts(evaluate.characters(pred, gold)) == (tp, fp, fn)


def test_confusion(spark):
    pred, gold, p, g = sides(spark, 11)
    want = {}
    for (_, _, ps), (_, _, gs) in zip(p, g):
        used = set()
        for s in gs:
            best, most = None, 0
            for i, o in enumerate(ps):
                w = min(s[1], o[1]) - max(s[0], o[0])
                if w > most:
                    best, most = i, w
            key = (s[2], "<MISSED>" if best is None else ps[best][2])
            want[key] = want.get(key, 0) + 1
            used.add(best)
        for i, o in enumerate(ps):
            if i not in used:
                want["<SPURIOUS>", o[2]] = want.get(("<SPURIOUS>", o[2]), 0) + 1
    assert {(r.gold_label, r.pred_label): r.n for r in evaluate.confusion(pred, gold).collect()} == want


def test_empty_sides(spark):
    d = flat(make(spark, [(1, "abc", [])]))
    assert evaluate.macro(evaluate.per_label(d, d)).first().asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "label_count": 0}
    assert evaluate.risk_weighted_recall(d, d, RISK_PROFILES["clinical_phi"]).first().risk_weighted_recall == 1.0
    assert {r.mode: r.f1 for r in evaluate.bundle(d, d).collect()} == dict.fromkeys(["strict", "exact_boundary", "partial_overlap", "char_level"], 0.0)


def test_coverage_and_risk(spark):
    there = spark.createDataFrame([("PHONE",), ("ID",), ("NAME",)], "label string")
    got = {r.identifier: r.status for r in evaluate.coverage(there, RISK_PROFILES["clinical_phi"]).collect()}
    assert (got["04"], got["17"], got["08"], got["05"], got["01"]) == ("covered", "n/a", "partial", "uncovered", "partial")
    gold = flat(make(spark, [(1, "abcdef", [(0, 1, "SSN"), (1, 2, "AGE"), (2, 3, "AGE")])]))
    pred = flat(make(spark, [(1, "abcdef", [(0, 1, "SSN"), (1, 2, "AGE")])]))
    assert abs(evaluate.risk_weighted_recall(pred, gold, RISK_PROFILES["clinical_phi"]).first().risk_weighted_recall - 11 / 12) < 1e-12


def test_worst_documents_sink_silent_ones(spark):
    d = make(spark, [(1, "abcdef", [(0, 1, "A")]), (2, "abcdef", []), (3, "abcdef", [(0, 1, "A"), (1, 2, "A")])])
    none = flat(make(spark, [(1, "abcdef", [])]))
    assert [r.doc_id for r in evaluate.worst_documents(d, none, flat(d), 10).orderBy("rank").collect()] == [3, 1, 2]


# --------------------------------------------------------------------------- output


def test_redaction_takes_the_longest(spark):
    rows = random_docs(seed=21)
    want = {}
    for i, t, spans in rows:
        for a, b, x in sorted(greedy(spans, KEYS[resolve.for_replacement]), reverse=True):
            t = t[:a] + f"[{x}]" + t[b:]
        want[i] = t
    assert {r.doc_id: r.output_text for r in output.rendered(make(spark, rows)).collect()} == want


def test_surrogates_are_aligned_and_repeatable(spark):
    rows = random_docs(seed=22, labels=["NAME", "DATE", "ID", "ODD"])
    d = make(spark, rows)
    got = output.with_surrogates(d, on_overlap="drop").collect()
    again = {r.doc_id: r.output_text for r in output.with_surrogates(d.repartition(7), on_overlap="drop").collect()}
    by_pair = {}
    for r in got:
        assert again[r.doc_id] == r.output_text
        kept = greedy([(s.start, s.end, s.label) for s in r.spans], KEYS[resolve.for_replacement])
        assert len(kept) == len(r.output_spans)
        for (a, b, x), s in zip(kept, r.output_spans):
            said = r.output_text[s.start : s.end]
            assert by_pair.setdefault((x, r.text[a:b]), said) == said
            assert x != "ODD" or said == "*" * (b - a)
            assert x != "ID" or (said.isdigit() and len(said) == max(4, b - a))
    with pytest.raises(Exception, match="overlapping spans"):
        output.with_surrogates(make(spark, [(1, "abc", [(0, 2, "NAME"), (1, 3, "NAME")])])).collect()


def test_leakage_is_capped_and_ignores_case(spark):
    d = make(spark, [(1, "aa Bob aaa", [(0, 2, "X"), (3, 6, "NAME"), (6, 7, "SPACE")])]).withColumn("output_text", F.lit("aaaa bob bob"))
    assert {r.label: (r.gold_count, r.leaked_count) for r in output.leakage_by_label(d).collect()} == {"X": (1, 1), "NAME": (1, 1)}
    n = d.select(output.over_redaction(F.col("text"), F.lit("aa  aa"), F.col("spans"))).first()[0]
    assert n == 1


def test_placeholders(spark):
    d = spark.createDataFrame([(1, "Seen [**First Name8 (NamePattern2) **] on\n[**2101-3-4**] [**zzz**]!")], "doc_id long, text string")
    r = output.fill_placeholders(d).first()
    assert [s.label for s in r.spans] == ["NAME", "DATE"] and "\n" not in r.text and r.text.endswith(" !") and "[**" not in r.text


# --------------------------------------------------------------------------- analytics, corpora, tags


def test_analytics(spark):
    d = make(spark, [(1, "a b", [(0, 1, "A"), (0, 3, "B")]), (2, "c", [(0, 1, "A")]), (3, "", [])])
    assert {(r.label_a, r.label_b): r.docs for r in analytics.label_cooccurrence(d).collect()} == {("A", "B"): 1}
    assert {r.doc_id: r.pairs for r in analytics.overlapping_pairs(d).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.bucket: r.docs for r in analytics.docs_by_span_count(d).collect()} == {"2": 1, "1": 1, "0": 1}
    one = analytics.numeric_summary(d.where("doc_id = 1").select(F.lit(2).alias("x")), "x").first()
    assert (one["mean"], one["std"]) == (2.0, 0.0)


def test_splits(spark):
    d = spark.createDataFrame([(1, "train"), (2, " train "), (3, ""), (4, None)], "doc_id long, split string")
    assert [r.doc_id for r in corpus.filter_splits(d, ["train"]).collect()] == [1]
    assert sorted(r.doc_id for r in corpus.filter_split_query(d, ["train", "(none)"]).collect()) == [1, 2, 3, 4]
    work, rest = corpus.work_and_rest(d, ["train"])
    assert work.count() == 1 and rest.count() == 3
    many = spark.range(103).withColumnRenamed("id", "doc_id")
    got = corpus.reassign_splits(many, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == dict(zip("abc", corpus.largest_remainder(103, [0.5, 0.3, 0.2])))
    named = corpus.reassign_splits(many, {"a": 1, "b": 1}, shuffle=False)
    assert {r.doc_id for r in named.where("split = 'a'").collect()} == set(range(51))


def test_apportionment():
    assert corpus.largest_remainder(10, [1, 1, 1]) == [3, 3, 4]
    assert corpus.largest_remainder(5, [0, -1]) == [2, 3] and corpus.largest_remainder(7, [1, 0, 1]) == [3, 0, 4]
    assert corpus.capped_counts(10, [3, 1], [4, 100]) == [4, 6] and corpus.capped_counts(99, [1, 1], [2, 3]) == [2, 3]
    with pytest.raises(ValueError):
        corpus.largest_remainder(-1, [1])


def test_sizes_and_copies(spark):
    d = make(spark, [(i, "abc", [(0, 1, "A")] if i % 2 else []) for i in range(20)])
    down = corpus.resize(d, 7)
    assert down.count() == 7 and {r.doc_id for r in down.collect()} == {r.doc_id for r in corpus.resize(d.repartition(9), 7).collect()}
    up = [r.doc_id for r in corpus.resize(d, 33).collect()]
    assert len(up) == 33 == len(set(up)) and sum("__rs" in x for x in up) == 13
    boosted = [r.doc_id for r in corpus.boost(d, "A", 2).collect()]
    assert len(boosted) == 40 == len(set(boosted))
    picked = corpus.proportional(d.withColumn("source", F.when(F.col("doc_id") < 5, "x").otherwise("y")), {"x": 3, "y": 1}, 12)
    assert {r.source: r["count"] for r in picked.groupBy("source").count().collect()} == {"x": 5, "y": 7}


def test_bio_tags_agree_with_the_fold(spark):
    rows = random_docs(seed=31)

    def brute(text, spans):
        import re

        toks = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        tags = ["O"] * len(toks)
        for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
            inside = False
            for i, (a, b) in enumerate(toks):
                if tags[i] != "O":
                    continue
                if a < s[1] and b > s[0]:
                    tags[i] = ("I-" if inside else "B-") + s[2]
                    inside = True
                elif inside:
                    break
        return tags

    d = make(spark, rows)
    want = {i: brute(t, s) for i, t, s in rows}
    assert {r.doc_id: r.tags for r in tagging.tagged(d).collect()} == want
    flat_rows = {}
    for r in tagging.bio_rows(d).orderBy("doc_id", "n").collect():
        flat_rows.setdefault(r.doc_id, []).append(r.tag)
    assert flat_rows == {k: v for k, v in want.items() if v}


def test_bioes(spark):
    d = spark.createDataFrame([(["B-A", "I-A", "O", "B-B", "B-A", "I-A", "I-A"],)], "t array<string>")
    r = d.select(tagging.bioes(F.col("t")).alias("b"), tagging.valid_bio(F.col("t")).alias("v")).first()
    assert r.b == ["B-A", "E-A", "O", "S-B", "B-A", "I-A", "E-A"] and r.v
    bad = spark.createDataFrame([(["O", "I-A"],), (["B-B", "I-A"],)], "t array<string>")
    assert not any(x[0] for x in bad.select(tagging.valid_bio(F.col("t"))).collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
        ("One two\n\nThree", ["One two", "Three"]),
        ("J. Doe is 5 mg. ok", ["J. Doe is 5 mg. ok"]),
        ('He said "yes." Then no. 5 came.', ['He said "yes."', "Then no. 5 came."]),
        ("a. b", ["a. b"]),
        ("Wait... Now!  Yes?", ["Wait...", "Now!", "Yes?"]),
        ("line one\nline two. \nNext", ["line one\nline two.", "Next"]),
        ("", []),
        ("  ", []),
    ],
)
def test_sentences(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    got = d.select(tagging.sentences(F.col("t")).alias("s")).first().s
    assert [x.text for x in got] == want and [text[x.start : x.end] for x in got] == want


def test_sentence_documents_clip_spans(spark):
    d = make(spark, [(1, "Ab cd. Ef gh.", [(3, 9, "A")])])
    got = [(r.doc_id, r.text, [(s.start, s.end) for s in r.spans]) for r in tagging.by_sentence(d).orderBy("doc_id").collect()]
    assert got == [("1#s0", "Ab cd.", [(3, 6)]), ("1#s1", "Ef gh.", [(0, 2)])]


def test_adjacent_names(spark):
    d = make(spark, [(1, "Ann Lee, Bo  Cy", [(0, 3, "NAME"), (4, 7, "NAME"), (9, 11, "NAME"), (13, 15, "NAME")])])
    assert spans_of(tagging.merge_adjacent(d))[1] == [(0, 7, "NAME"), (9, 11, "NAME"), (13, 15, "NAME")]


def test_differences(spark):
    a, b = make(spark, [(1, "abcd", [(0, 1, "A"), (1, 2, "B")])]), make(spark, [(1, "abcde", [(1, 2, "B"), (0, 1, "C")])])
    assert {(r.start, r.label): r.status for r in compare.span_diff(flat(a), flat(b)).collect()} == {(0, "A"): "removed", (1, "B"): "kept", (0, "C"): "added"}
    assert {r.kind: r.n for r in compare.pipeline_summary(flat(a), flat(b)).collect()} == {"relabeled": 1, "agreed": 1}
    r = compare.frame_stats(a, b).first()
    assert (r.added, r.removed, r.text_changed, r.char_delta) == (1, 1, True, 1)
    f = lambda d: d.select(compare.fingerprint(F.col("text"), F.col("spans"))).first()[0]
    assert f(a) == f(make(spark, [(9, "abcd", [(1, 2, "B"), (0, 1, "A")])])) != f(b)
    w = spark.createDataFrame([("a b c", "a x c")], "a string, b string").select(compare.word_diff(F.col("a"), F.col("b")).alias("d")).first().d
    assert [(x.op, x.text) for x in w] == [("equal", "a"), ("remove", "b"), ("add", "x"), ("equal", "c")]


def test_unique_names_rank_a_hot_base_over_ranges(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "b") for i in range(900)] + [(None, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    named = corpus.unique_names(df, "source", ["doc_id"])
    want, seen = {}, {}
    for i, s in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        seen[s] = seen.get(s, 0) + 1
        want[i] = s if s is None or seen[s] == 1 else f"{s}__{seen[s]}"
    assert {r.doc_id: r.stem for r in named.collect()} == want and named.columns == ["doc_id", "source", "stem"]
    assert "__range" in named._jdf.queryExecution().optimizedPlan().toString()
