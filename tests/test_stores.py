"""Changes of single documents, exports that are published whole, and pages that read their own part."""

import os

import pytest
from pyspark.sql import functions as F

from annolake.operators import analytics, audit
from annolake.operators.paging import page
from annolake.schema import SPANS
from annolake.sources import readers, writers
from annolake.sources.buckets import BucketedCorpus

DOCS = f"doc_id string, text string, spans {SPANS}"


def corpus(spark, tmp_path, n=200):
    c = BucketedCorpus(spark, str(tmp_path / "c"), 8)
    c.create(spark.createDataFrame([(str(i), f"text {i}", [(0, 4, "X", None, None)]) for i in range(n)], DOCS))
    return c


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_an_update_writes_one_bucket(spark, tmp_path):
    c = corpus(spark, tmp_path)
    before = c.folders()
    assert c.update(spark.createDataFrame([("17", "new", [])], DOCS)) == 2
    after = c.folders()
    assert sum(before[k] != after[k] for k in before) == 1 and texts(c.read())["17"] == "new" and len(texts(c.read())) == 200
    assert texts(c.read(1))["17"] == "text 17" and c.versions() == [1, 2]
    written = {d for _, ds, _ in os.walk(tmp_path / "c" / "data") for d in ds if d.startswith("bucket=")}
    assert len(written) == 8 and sum(len([d for d in ds if d.startswith("bucket=")]) for _, ds, _ in os.walk(tmp_path / "c" / "data")) == 9


def test_a_failed_update_leaves_the_version_before(spark, tmp_path):
    c = corpus(spark, tmp_path)
    with pytest.raises(Exception, match="exceeds"):
        c.update(spark.createDataFrame([("17", "new", [(0, 99, "X", None, None)])], DOCS))
    with pytest.raises(KeyError, match="no such documents"):
        c.update(spark.createDataFrame([("nobody", "new", [])], DOCS))
    assert c.versions() == [1] and texts(c.read())["17"] == "text 17"
    # a manifest that was cut short is no version
    spark.createDataFrame([(2, 0, "x")], "version long, bucket int, path string").write.mode("append").parquet(str(tmp_path / "c" / "manifest"))
    assert c.versions() == [1] and len(texts(c.read())) == 200


def test_removal_and_bad_input(spark, tmp_path):
    c = corpus(spark, tmp_path, 5)
    c.remove(spark.createDataFrame([(str(i),) for i in range(4)], "doc_id string"))
    assert texts(c.read()) == {"4": "text 4"}
    c.remove(spark.createDataFrame([("4",)], "doc_id string"))
    assert c.read().count() == 0 and c.versions() == [1, 2, 3] and len(texts(c.read(1))) == 5
    with pytest.raises(KeyError):
        c.read(9)
    with pytest.raises(ValueError, match="there already"):
        c.create(spark.createDataFrame([], DOCS))
    with pytest.raises(ValueError, match="repeated"):
        BucketedCorpus(spark, str(tmp_path / "d")).create(spark.createDataFrame([("a", "x", []), ("a", "y", [])], DOCS))


def test_export_is_one_job_and_published_whole(spark, tmp_path):
    good = spark.createDataFrame([(str(i), "Ann saw Bo", [(0, 3, "NAME", None, None)]) for i in range(20)], DOCS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("export", "export")
    writers.surrogate_jsonl(good, str(tmp_path / "good"))
    assert len(tracker.getJobIdsForGroup("export")) == 1
    assert readers.jsonl(spark, str(tmp_path / "good")).count() == 20
    bad = good.unionByName(spark.createDataFrame([("b", "abc", [(0, 2, "X", None, None), (1, 3, "Y", None, None)])], DOCS))
    with pytest.raises(ValueError, match="overlapping spans in 1 documents, b"):
        writers.surrogate_jsonl(bad, str(tmp_path / "bad"))
    assert sorted(os.listdir(tmp_path)) == ["good"]
    with pytest.raises(ValueError, match="there already"):
        writers.surrogate_jsonl(good, str(tmp_path / "good"))


@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_slices_of_the_sorted_table(spark, descending):
    df = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(700))).alias("k"), "id").repartition(6)
    order = F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_first()
    rows = [tuple(r) for r in df.orderBy(order, "id").collect()]
    for offset, limit in ((0, 10), (5, 0), (30, 60), (55, 10), (1490, 40), (2935, 10), (2935, 100), (2990, 50), (3000, 5)):
        got = [tuple(r) for r in page(df, F.col("k"), offset, limit, [F.col("id")], descending).collect()]
        assert got == rows[offset : offset + limit], (offset, limit)
    with pytest.raises(ValueError):
        page(df, F.col("k"), -1, 5)


def test_a_late_page_reads_its_ranges_only(spark, tmp_path):
    spark.range(100000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.array().cast(SPANS).alias("spans")).repartitionByRange(4, "doc_id").write.parquet(str(tmp_path / "t"))
    df = page(spark.read.parquet(str(tmp_path / "t")), F.col("doc_id"), 70000, 50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id" in plan and "LessThan(doc_id" in plan
    assert [r.doc_id for r in df.collect()] == list(range(70000, 70050))
    assert analytics.preview(spark.read.parquet(str(tmp_path / "t")), 99990, 50).count() == 10


def test_pages_of_times_words_and_empty_tables(spark):
    log = spark.sql("SELECT cast(id AS string) AS id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS timestamp FROM range(500)")
    assert [r.id for r in audit.page(log, 100, 3).collect()] == ["399", "398", "397"]
    terms = spark.createDataFrame([(w,) for w in ("b", "A", "c", "B", "aa")], "term string")
    assert [r.term for r in readers.search_terms(terms, "", 1, 3).collect()] == ["aa", "B", "b"]
    assert page(log.limit(0), F.col("id"), 0, 5).count() == 0
