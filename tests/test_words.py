"""Words and tags of whole batches (F13, F15, F16, F20 of round 3)."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from annolake.functions import words
from annolake.functions.text import matches
from annolake.operators import evaluate, tagging
from annolake.plans import catalog, catalog_io
from annolake.schema import SPANS
from annolake.sources import readers, writers


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def own_documents(spark, tmp_path):
    text = "Anned walk the abced 12 7 nation. x"
    rows = [(1, text, "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, "no such here", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_as_java_finds_them(spark):
    rng = random.Random(5)
    odd = "ab\u00e9\u0416\U0001f600\u2010\u200b\u180e\ufeff\u0e01" + " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2000\u2007\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, " ", "a", "\u3000", "a\u3000", "\u00e9", "\ufdd0x\ufdd1 y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    for r in docs.select("text", tagging.tokens(F.col("text")).alias("got"), matches(F.col("text"), r"(?U)\S+").alias("want")).collect():
        assert r.got == r.want, r.text


def test_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(words, "PART", 3)
    texts = pa.array(["x", "ab cd", "", None, "e", "f g"])
    cuts = list(words._cuts(texts))
    assert cuts == [(0, 1), (1, 2), (2, 5), (5, 6)]
    assert [[w["text"] for w in row] for a, b in cuts for row in words.Words(texts.slice(a, b - a)).rows().to_pylist()] == [["x"], ["ab", "cd"], [], [], ["e"], ["f", "g"]]
    assert list(words._cuts(texts.slice(0, 0))) == [] and words.Words(texts.slice(0, 0)).rows().to_pylist() == []


def test_tags_of_odd_spans(spark):
    spans = lambda *x: [(a, b, label, None, None) for a, b, label in x]
    rows = [(1, "aa bb cc", spans((0, 99, "X"), (3, 5, "Y"))), (2, "aa bb", spans((4, 4, "X"), (2, 3, "Y"), (9, 12, "Z"))), (3, "aa", None), (4, None, spans((0, 2, "X"))), (5, "aa bb", spans((3, 5, "A-B"), (0, 2, "A-B"))), (6, "cc", [])]
    d = spark.createDataFrame(rows, f"doc_id long, text string, spans {SPANS}").coalesce(1)
    assert {r.doc_id: r.tags for r in tagging.tagged(d).collect()} == {1: ["B-X", "I-X", "I-X"], 2: ["O", "B-X"], 3: None, 4: [], 5: ["B-A-B", "B-A-B"], 6: ["O"]}
    assert sorted((r.doc_id, r.n, r.token, r.tag) for r in tagging.bio_rows(d).collect()) == [(1, 0, "aa", "B-X"), (1, 1, "bb", "I-X"), (1, 2, "cc", "I-X"), (2, 0, "aa", "O"), (2, 1, "bb", "B-X"), (5, 0, "aa", "B-A-B"), (5, 1, "bb", "B-A-B"), (6, 0, "cc", "O")]


def test_entities_shuffle_tagged_rows_only(spark, tmp_path):
    """all tokens passed a window, and spans were found twice, for a filter too."""
    got = catalog.entities_of_tags(spark, own_documents(spark, tmp_path))
    plan = optimized(got)
    assert plan.count("regexp_replace(text") == 5 and plan.index("Window") < plan.index("Filter") < plan.index("MapInArrow")
    assert sorted((r.start, r.end, r.label) for r in got.collect()) == [(0, 10, "NAME"), (11, 20, "DATE"), (21, 23, "ID"), (24, 25, "ID"), (26, 33, "CITY")]
    tags = ["O", "I-A", "I-A", "O", "I-A", "B-A", "I-B", "O"]
    rows = spark.createDataFrame([(1, n, 2 * n, 2 * n + 1, t) for n, t in enumerate(tags)], "doc_id int, n int, start int, end int, tag string")
    of = lambda **how: sorted((r.start, r.end, r.label) for r in tagging.entities_of_rows(rows, **how).collect())
    assert of() == of(gapless=True) == [(2, 5, "A"), (8, 9, "A"), (10, 11, "A"), (12, 13, "B")]


def test_entity_report_reads_documents_once(spark, tmp_path):
    """texts were read and cut into tokens for either side."""
    got = catalog_io.entity_report(spark, own_documents(spark, tmp_path))
    assert optimized(got).count("MapInArrow") == 1
    rows = {r.label: (r.tp, r.fp, r.fn, r.support) for r in got.collect()}
    assert rows["ID"] == (1, 1, 0, 1) and rows["micro"] == tuple(map(sum, zip(*(v for k, v in rows.items() if k != "micro"))))
    none = spark.createDataFrame([], "doc_id int, n int, start int, end int, gold string, pred string")
    assert [(r.label, r.tp, r.f1) for r in evaluate.entity_report(none).collect()] == [("micro", 0, 0.0)]


def test_written_tags_come_from_batches(spark, tmp_path):
    """F16: a document's tokens and tags were written from folds over its arrays."""
    d = spark.createDataFrame([(1, "aa bb", [(0, 2, "X", None, None)]), (2, "", []), (3, None, [])], f"doc_id long, text string, spans {SPANS}")
    writers.token_classification(d, f"{tmp_path}/t")
    assert sorted((r.id, r.tokens, r.ner_tags) for r in spark.read.json(f"{tmp_path}/t").collect()) == [("1", ["aa", "bb"], ["B-X", "O"]), ("2", [], []), ("3", [], [])]
    assert "aggregate(" not in optimized(tagging.tagged(d))


def test_lines_of_tags_without_places(spark, tmp_path):
    """lines were numbered, with a window over each block of a file and two joins, to count tags."""
    d = spark.createDataFrame([(1, "aa bb", [(0, 2, "X", None, None)]), (2, "", []), (3, "-DOCSTART-x c", [])], f"doc_id long, text string, spans {SPANS}")
    writers.conll(d, f"{tmp_path}/c")
    got = readers.conll(spark, f"{tmp_path}/c", places=False)
    assert not any(x in optimized(got) for x in ("Join", "Window", "Aggregate"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, readers.conll(spark, f"{tmp_path}/c").select("file", "token", "tag").collect()))
