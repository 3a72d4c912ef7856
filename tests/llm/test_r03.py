"""Findings of round 3 about the numbered operators."""

import pyarrow as pa

import corpus_pipeline
from annolake.llm import url_filter
from annolake.llm.common import Stored


def test_host_rules_are_those_of_the_contract(spark, tmp_path):
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.verdict for r in url_filter.BASE_RULES} == said
    urls = ["http://site.net/de/1", "http://net/de/", "http://example.net/de/7", "http://example.net/de/8", "http://m.site.net/de/12.html", "http://a.example.com/en/7", "http://site.com/en/7", "http://org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == [("net/de/", "allow")] * 3 + [("example.net/de/8", "block"), ("net/de/", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("org/es/", "block")]


def test_a_stored_table_is_emptied_without_python_workers(spark, monkeypatch):
    held = Stored(spark.range(5).selectExpr("id", "array(id) AS ids"))
    assert held.read().count() == 5
    monkeypatch.setattr(type(spark), "createDataFrame", None)  # of Python's rows: each executor starts workers for them
    held.drop()
    assert held.read().count() == 0


def test_stages_hand_documents_over_in_small_batches(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")  # 10 MB
    spark.createDataFrame([("a", "some words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"]) for b in batches)
    before = spark.conf.get(corpus_pipeline.BATCH_CONF)
    try:
        corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        assert max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()) < 5_000_000
    finally:
        spark.conf.set(corpus_pipeline.BATCH_CONF, before)
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2000
    assert spark.conf.get(corpus_pipeline.BATCH_CONF) == before
