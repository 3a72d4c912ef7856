"""Findings of round 3: work that grows with the input only."""

import duckdb
from pyspark.sql import functions as F

from annolake.functions.automaton import term_hits
from annolake.functions.starts import condition
from annolake.operators import detect, tagging
from annolake.plans import catalog, catalog_io, catalog_more, pipeline
from annolake.plans.catalog import ORACLES
from annolake.schema import SPANS
from annolake.sources import readers, stores, writers


def spanned(spark, n):
    return spark.createDataFrame([(f"d{i}", f"ab\n\n{i}", [(0, 2, "X", None, "s")] * (1 - i % 2)) for i in range(n)], f"doc_id string, text string, spans {SPANS}")


def test_folders_of_stems_are_read_by_a_few_tasks(spark, tmp_path):
    at = str(tmp_path / "w")
    writers.brat(spanned(spark, 300), at)
    assert len(list((tmp_path / "w" / "txt").glob("stem=*/*.txt"))) == len(list((tmp_path / "w" / "ann").glob("stem=*/*.txt"))) == 300
    got = readers.brat_parts(spark, at)
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism  # once a task for 4 MB of each file's opening, after a listing task a folder
    assert sorted((r.doc_id, r.text, len(r.spans)) for r in got.collect()) == sorted((f"d{i}", f"ab\n\n{i}", 1 - i % 2) for i in range(300))


def test_all_steps_come_from_one_scan(spark):
    pack = {"A": ["a+"], "B": ["b+"]}
    config = {"pipes": [{"type": "regex_ner", "config": {"pack": pack}}, {"type": "label_filter", "config": {"drop": ["B"]}}, {"type": "label_mapper", "config": {"mapping": {"A": "C"}}}]}
    docs = spark.createDataFrame([(1, "aab"), (2, "bb"), (3, None)], "doc_id long, text string")
    got = pipeline.trace(docs, config)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted((r.step, r.type, r.doc_id, r.start, r.end, r.label) for r in got.collect()) == [(0, "regex_ner", 1, 0, 2, "A"), (0, "regex_ner", 1, 2, 3, "B"), (0, "regex_ner", 2, 0, 2, "B"), (1, "label_filter", 1, 0, 2, "A"), (2, "label_mapper", 1, 0, 2, "C")]


def test_hits_of_terms_stay_small(spark):
    docs = spark.createDataFrame([(1, "the cat of The"), (2, None), (3, "")], "doc_id long, text string")
    found = docs.select("doc_id", term_hits(F.col("text"), [("the", True, "B"), ("the", True, "A"), ("of", True, "B")]).alias("h"))
    assert {r.doc_id: [tuple(x) for x in r.h] for r in found.collect()} == {1: [(0, 3, "A"), (0, 3, "B"), (8, 10, "B"), (11, 14, "A"), (11, 14, "B")], 2: [], 3: []}
    assert ", 204" not in found._jdf.queryExecution().executedPlan().toString()  # no pandas rows of dicts


def test_tag_report_reads_and_shuffles_documents_once(spark, tmp_path):
    spark.createDataFrame([(1, "Anned walk ab 12", "en", "s"), (2, "", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog_io.tag_report_binary(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.n for r in got.collect()) == 4


def test_phrases_that_overlap_themselves_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, "ntin. In. In to"), (2, "In. in. in. in"), (3, "an in.  in")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("in. in",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.start, r.end) for r in catalog_more.dictionary_phrases(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(r[:3] for r in db.execute(ORACLES["dictionary_phrases"]).fetchall()) == [(2, 0, 6), (2, 8, 14), (3, 3, 10)]


def test_one_search_gives_places_and_groups(spark):
    pack = {"ID": [r"\b(?:mrn|case\s+no)\s*[:#]?\s*([A-Z]?\d{2,})\b", r"\bDEA\s*(\d+)"], "ORG": [r"\b(?:(?-i:[A-Z])[a-z]+\s+){1,2}(?-i:Clinic)\b"], "YEAR": [r"'\d{2}s\b", r"\b(?:in|since)\s+(\d{4})\b"]}
    text = "Case no: A12, dea 7; mrn 345 Old Town Clinic ſince 1999, the '90s, IN 2001 old town clinic"
    docs = spark.createDataFrame([(1, text), (2, f"﷐{text}﷑"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end, x.label) for x in r.spans] for r in detect.regex_ner(docs, pack).collect()}
    said = sorted((text.index(x), text.index(x) + len(x), label) for x, label in (("A12", "ID"), ("7", "ID"), ("345", "ID"), ("Old Town Clinic", "ORG"), ("1999", "YEAR"), ("'90s", "YEAR"), ("2001", "YEAR")))
    assert got == {1: said, 2: [(a + 1, b + 1, x) for a, b, x in said], 3: [], 4: []}
    assert condition(pack["ID"], "(?iU)") and condition(["a|(?i:b)"], "") == condition([r"\p{L}a", "b"], "") == condition(["a*", "b"], "") == ""


def test_sentences_of_tag_files_need_no_row_of_a_file(spark, tmp_path):
    (tmp_path / "own.txt").write_text("a X\nb Y\n-DOCSTART- x\nc Z\n  \nd Z\n\n\n\n\ne Z")
    rows = readers.conll(spark, str(tmp_path / "own.txt"))
    assert sorted(r.line for r in readers.conll_sentences(rows).collect()) == ["a b", "c", "d", "e"]
    assert readers.conll_text(rows).first().text == "a b\nc\nd\ne"


def test_a_dataset_is_not_shuffled_by_its_name(spark, tmp_path):
    store = stores.Datasets(spark, str(tmp_path / "s"))
    store.commit("one.set", spanned(spark, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = store.current()
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labels_of_tokens_stay_in_their_document(spark):
    text, spans = "aa bb cc dd", [(0, 5, "P-Q", None, "s"), (0, 2, "R", None, "s"), (3, 8, "S", None, "s"), (4, 11, "T", None, "s")]
    d = spark.createDataFrame([(1, text, spans), (2, "", []), (3, "aa", [])], f"doc_id long, text string, spans {SPANS}")
    got = {r.doc_id: r.x for r in d.select("doc_id", tagging.span_labels(tagging.tokens(F.col("text")), F.col("spans")).alias("x")).collect()}
    assert got == {1: ["R", "P_Q", "S", "T"], 2: [], 3: [None]}


def test_both_sides_come_from_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "Anned walk the abced 12 7", "en", "s"), (2, "the abced", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    scans = lambda f: f(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("documents.parquet") or f(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(catalog.compare_runs) == 2 and scans(catalog_io.custom_risk) == 1
    assert "[doc_id#" in (plan := catalog.mode_bundle(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()) and "regexp" not in plan


def test_lines_of_broken_files_are_dealt_by_size(spark, tmp_path):
    spark.range(40).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = {f for f in catalog_io.broken_lines(spark, str(tmp_path)).inputFiles()}
        assert len(files) > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
