"""Match places, tags and joins against brute force; stores; settings; model answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from annolake.functions import text as texts
from annolake.operators import detect, evaluate, output, synthesis, tagging
from annolake.plans import pipeline
from annolake.schema import SPANS
from annolake.sources import readers, stores


def test_places_of_many_matches(spark):
    """Lists longer than one fold's run, code points beyond the BMP, no match, empty and null texts."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab1 \n😀é") for _ in range(n))) for i, n in enumerate((0, 3, 200, 1500, 4000))] + [(9, None), (10, "zz")]
    d = spark.createDataFrame(rows, "i int, t string")
    for r in d.select("i", "t", texts.matches(F.col("t"), "[ab]+").alias("m"), texts.find_all(F.col("t"), F.lit("a")).alias("f")).collect():
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("[ab]+", r.t or "")]
        assert [(x.start, x.end, x.text) for x in r.m] == want
        assert (r.f or []) == [m.start() for m in re.finditer("a", r.t or "")]


def brute_tags(tokens, spans):
    tags = ["O"] * len(tokens)
    for a, b, label in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        first = True
        for i, (x, y) in enumerate(tokens):
            if x < b and y > a and tags[i] == "O":
                tags[i] = ("B-" if first else "I-") + label
                first = False
    return tags


def test_tags_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcd  \n") for _ in range(rng.randint(0, 300)))
        spans = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, max(0, len(t) - 1))
            b = min(len(t), a + rng.randint(1, 40))
            if a < b:
                spans.append((a, b, rng.choice("XYZ"), None, None))
        rows.append((i, t, spans))
    d = spark.createDataFrame(rows, f"doc_id int, text string, spans {SPANS}")
    got = {}
    for r in tagging.bio_rows(d).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append((r.token, r.tag))
    for i, t, spans in rows:
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        assert got.get(i, []) == [(t[a:b], tag) for (a, b), tag in zip(at, brute_tags(at, [s[:3] for s in spans]))]
    tokens = tagging.exploded(d, ["doc_id"], tagging.tokens(F.col("text")), "n", "t").select("doc_id", "n", "t.start", "t.end")
    held = {(r.doc_id, r.n): r.label for r in tagging.token_spans(tokens, d.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")).collect()}
    for i, t, spans in rows:
        for n, m in enumerate(re.finditer(r"\S+", t)):
            over = sorted(s[:3] for s in spans if s[0] <= m.start() and m.end() <= s[1])
            assert held[i, n] == (over[0][2] if over else None)


def test_store(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "s"), "x int")
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    s.save("a", one(1, 2))
    s.save("b", one())
    s.save("a", one(3))
    assert [r.x for r in s.load("a").collect()] == [3] and s.names() == ["a"]
    with pytest.raises(ValueError):
        s.save("a", one(4), overwrite=False)
    with pytest.raises(ValueError):
        s.save("../x", one(4))
    s.rename("a", "c")
    assert s.names() == ["c"] and [r.x for r in s.load("c").collect()] == [3]
    with pytest.raises(KeyError):
        s.load("a")
    s.delete("c")
    assert s.names() == [] and s.current().count() == 0
    s.save("c", one(5))
    assert [r.x for r in s.load("c").collect()] == [5]


def test_pipeline_store_refuses_invalid(spark, tmp_path):
    s = stores.Pipelines(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        s.put("x", {"pipes": [{"type": "nothing"}]})
    s.put("x", pipeline.profile("fast"))
    assert s.config("x")["pipes"][0]["type"] == "regex_ner"


def test_whitelist_settings():
    got = detect.whitelist_settings({"A": {"terms": ["x"], "remap": "Z"}, "B": {}}, {"A": {"terms": ["w"]}, "C": {"terms": ["c"]}}, {"A": "Q", "B": None, "C": "D", "N": "M"})
    assert got["A"] == {"enabled": True, "remap": "Z", "terms": ["w", "x"], "dictionaries": []}
    assert got["B"]["enabled"] is False and got["C"]["remap"] == "D" and "N" not in got


def test_model_answers(spark):
    raw = {
        1: 'Clinical Note: "Ann said \\"no\\".\\nOk", PHI: {"NAME": ["Ann"], "AGE": null, "ID": "no"}\n\nBye',
        2: "Clinical Note: Bo is here,\nPHI: {'NAME': [\"Bo\"]}",
        3: 'Clinical Note: Cy, PHI: so "NAME": ["Cy"], "X": [oops',
        4: '{"clinical_note": "Di left", "entities": {"NAME": ["Di"]}}',
        5: "just talk",
        6: None,
    }
    got = {r.i: r for r in synthesis.parsed(spark.createDataFrame(list(raw.items()), "i int, raw string")).collect()}
    assert got[1].note == 'Ann said "no".\nOk' and got[1].entities == {"NAME": ["Ann"], "AGE": [], "ID": ["no"]}
    assert got[2].note == "Bo is here" and got[2].entities == {"NAME": ["Bo"]}
    assert got[3].entities == {"NAME": ["Cy"]}
    assert got[4].note == "Di left" and got[4].entities == {"NAME": ["Di"]}
    assert got[5].note == "just talk" and got[5].entities == {} and got[6].note is None


def test_name_forms(spark):
    n = spark.range(4000).select(output.made_up_name(F.col("id").cast("string")).alias("x")).groupBy("x.form").count().collect()
    share = {r.form: r["count"] / 4000 for r in n}
    assert all(abs(share[k] - v / 100) < 0.04 for k, v in output.NAME_FORMS)


def test_tag_modes(spark):
    d = spark.createDataFrame([("B-X", "I-X"), ("O", "B-Y")], "gold string, pred string")
    assert [tuple(r) for r in evaluate.remapped_tags(d, "token").collect()] == [("X", "X"), ("O", "Y")]
    assert [tuple(r) for r in evaluate.remapped_tags(d, "binary").collect()] == [("PHI", "PHI"), ("O", "PHI")]


def test_spread_keeps_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id")
    assert sorted(r[0] for r in readers.spread(d).collect()) == sorted(r[0] for r in d.collect())


def test_numbered_lines_over_blocks(spark, tmp_path):
    """Lines keep their numbers however files are split."""
    lines = ["" if i % 7 == 0 else "w%d O" % i for i in range(500)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
        rows = readers.conll(spark, str(tmp_path)).collect()
        assert len({r.block for r in got}) > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("a", "b"):
        assert [r.line for r in sorted((r for r in got if r.path.endswith(f"{name}.txt")), key=lambda r: r.i)] == lines
    assert {(r.file, r.n, r.sentence) for r in rows} == {(f"{name}.txt", i, i // 7 + 1) for name in ("a", "b") for i, x in enumerate(lines) if x}
