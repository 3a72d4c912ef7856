"""Round trips of readers and writers, pipelines as JSON, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from annolake.operators import corpus, output
from annolake.plans import catalog, pipeline
from annolake.schema import SPANS
from annolake.sources import readers, writers
from annolake.streaming import streams

DOC = f"doc_id string, text string, metadata map<string,string>, spans {SPANS}"


def some(spark):
    span = lambda a, b, x: dict(start=a, end=b, label=x, confidence=None, source=None)
    return spark.createDataFrame([("a/b", "Ann met Bo.\nOk é", {"split": "train"}, [span(0, 3, "NAME"), span(8, 10, "NAME")]), ("a b", "none", {}, []), ("a_b", "x 😀 y", {}, [span(2, 3, "E")])], DOC)


def rows(df):
    return sorted((r.doc_id, r.text, [(s.start, s.end, s.label) for s in r.spans]) for r in df.collect())


def test_jsonl_round_trip(spark, tmp_path):
    writers.jsonl(some(spark), str(tmp_path / "j"))
    assert rows(readers.load(spark, jsonl_path=str(tmp_path / "j"))) == rows(some(spark))
    assert rows(readers.load_spec(spark, f"jsonl:{tmp_path / 'j'}")) == rows(some(spark))
    (tmp_path / "bad.jsonl").write_text('{"document": {"id": "1"\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        readers.load(spark)
    with pytest.raises(ValueError):
        readers.load_spec(spark, "csv:x")


def test_brat(spark, tmp_path):
    for split in ("train", "test"):
        d = tmp_path / "c" / split
        d.mkdir(parents=True)
        (d / "n 1.txt").write_text("Ann met Bo")
        (d / "n 1.ann").write_text("T1\tNAME 0 3\tAnn\nT2\tNAME 0 3;8 10\tAnn Bo\nR1\tx\nT3\tNAME a 3\tz\nT4\tNAME 8 10\tBo\n")
        (d / "alone.txt").write_text("no ann")
    assert rows(readers.brat(spark, str(tmp_path / "c" / "train"), "p_")) == [("p_n 1", "Ann met Bo", [(0, 3, "NAME"), (8, 10, "NAME")])]
    got = readers.brat_corpus(spark, str(tmp_path / "c"))
    assert sorted((r.doc_id, r.metadata["split"]) for r in got.collect()) == [("test__n 1", "test"), ("train__n 1", "train")]
    writers.brat(some(spark), str(tmp_path / "w"))
    # a/b, "a b" and a_b share a stem; names go by id
    text = {r.doc_id: (r.text, [(x.start, x.end, x.label) for x in r.spans]) for r in some(spark).collect()}
    want = sorted((stem, *text[i]) for stem, i in zip(("a_b", "a_b__2", "a_b__3"), sorted(text)))
    assert rows(readers.brat_parts(spark, str(tmp_path / "w"))) == want
    writers.brat_files(some(spark), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == sorted(f"{stem}.{ext}" for stem, _, _ in want for ext in ("ann", "txt"))
    assert rows(readers.brat(spark, str(tmp_path / "f"))) == want


def test_stems(spark):
    d = spark.createDataFrame([("a/b",), ("..x..",), ("///",), ("é-1.2",), ("z" * 300,)], "doc_id string")
    assert [r[0] for r in d.select(writers.stem(F.col("doc_id"))).collect()] == ["a_b", "x", "doc", "é-1.2", "z" * 200]


def test_production_export(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text(json.dumps({"schema_version": 1, "id": " ", "text": "Ann", "spans": [{"start": 0, "end": 3, "label": "NAME", "confidence": "x"}], "source_label": "s", "resolved": True}) + "\n")
    r = readers.production_export(spark, str(p)).first()
    assert r.doc_id == "doc" and r.spans[0].confidence is None and r.metadata == {"source_label": "s", "export_resolved": "true"}
    p.write_text(json.dumps({"schema_version": 2, "id": "1", "text": "Ann"}) + "\n")
    with pytest.raises(Exception, match="schema_version"):
        readers.production_export(spark, str(p)).collect()


def test_asq(spark, tmp_path):
    (tmp_path / "q.txt").write_text('===QUERY===\nAnn saw Bo and Ann\n===PHI_TAGS===\n{"identifier_type": "NAME", "value": "Bo"}\n{"identifier_type": "NAME", "value": "Ann"}\nbroken\n{"identifier_type": "NAME", "value": "Bo"}\n===QUERY===\nplain\n===PHI_TAGS===\n')
    assert rows(readers.asq_phi(spark, str(tmp_path / "q.txt"))) == [("asq_1", "Ann saw Bo and Ann", [(8, 10, "NAME"), (15, 18, "NAME"), (8, 10, "NAME")]), ("asq_2", "plain", [])]


def test_notes_and_raw_texts(spark, tmp_path):
    (tmp_path / "n.csv").write_text('ROW_ID,CHARTDATE,TEXT\n1,2020-01-02,"a ""b""\nc"\n2,01/03/2020,x\n3,odd,y\n4,2020-01-01,\n')
    got = sorted((r.doc_id, r.text, str(r.chart_date)) for r in readers.mimic_notes(spark, str(tmp_path / "n.csv")).collect())
    assert got == [("1", 'a "b"\nc', "2020-01-02"), ("2", "x", "2020-01-03"), ("3", "y", "None")]
    (tmp_path / "t.jsonl").write_text('{"id": "7", "text": "a"}\n\n{"document": {"id": "8", "text": "b"}}\n{"text": "c"}\n')
    assert sorted((r.doc_id, r.text) for r in readers.raw_texts(spark, str(tmp_path / "t.jsonl"), "jsonl").collect()) == [("7", "a"), ("8", "b"), ("t_line_3", "c")]
    assert sorted(r.doc_id for r in readers.raw_texts(spark, str(tmp_path / "t.jsonl"), "jsonl", False).collect()) == ["7", "8", "line_3"]


def test_physionet_and_sentences(spark, tmp_path):
    (tmp_path / "id.text").write_text("START_OF_RECORD=1||||1||||\nAnn\nhere\n||||END_OF_RECORD\n\nSTART_OF_RECORD=2||||1||||\nBo\n||||END_OF_RECORD\n")
    (tmp_path / "a.csv").write_text("record_id,begin,length,type\n1,0,3,NAME\n1,50,3,NAME\n")
    got = readers.physionet(spark, str(tmp_path / "id.text"), str(tmp_path / "a.csv")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text[:8], len(r.spans)) for r in got][0][2] == 1 and got[0].text.startswith("Ann here")
    (tmp_path / "s.txt").write_text("Bo saw Bo on 5 May\\tNAME: Bo\\tNAME: Bo\\tDATE: 5 May=>2020-05-05\nno tabs\n")
    assert rows(readers.sentence_annotations(spark, str(tmp_path / "s.txt"))) == [("line_0", "Bo saw Bo on 5 May", [(0, 2, "NAME"), (7, 9, "NAME"), (13, 18, "DATE")])]


def test_phrases(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# no\nAnn\n\n Bo \n")
    (tmp_path / "a.csv").write_text("term,x\nAnn,1\nCy,2\n")
    (tmp_path / "a.json").write_text('{"terms": ["Ann", "Di"]}')
    (tmp_path / "b.json").write_text('["Ed"]')
    got = lambda name, kind: sorted(r.term for r in readers.phrases(spark, str(tmp_path / name), kind).collect())
    assert (got("a.txt", "txt"), got("a.csv", "csv"), got("a.json", "json"), got("b.json", "json")) == (["Ann", "Bo"], ["Ann", "Cy"], ["Ann", "Di"], ["Ed"])
    t = readers.phrases(spark, str(tmp_path / "a.txt"), "txt")
    assert [r.term for r in readers.search_terms(t, "AN").collect()] == ["Ann"]


def test_conll(spark, tmp_path):
    writers.conll(some(spark).where("doc_id = 'a/b'"), str(tmp_path / "c"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "c")).collect())
    assert text.startswith("-DOCSTART- -X- O O\n\nAnn B-NAME\nmet O\nBo. B-NAME")
    back = readers.conll(spark, str(tmp_path / "c"))
    assert [(r.token, r.tag) for r in back.orderBy("n").collect()][:2] == [("Ann", "B-NAME"), ("met", "O")]
    assert readers.conll_text(back).first().text == "Ann met Bo. Ok é"
    writers.token_classification(some(spark), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 3


@pytest.mark.parametrize("kind", ["text", "json", "csv", "parquet"])
def test_exports(spark, tmp_path, kind):
    writers.export(output.rendered(some(spark)), str(tmp_path / "o"), kind)
    if kind == "parquet":
        assert {r.span_count for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        writers.export(output.rendered(some(spark)), str(tmp_path / "p"), "xls")


def test_surrogate_export_is_all_or_nothing(spark, tmp_path):
    writers.surrogate_jsonl(some(spark), str(tmp_path / "ok"))
    got = readers.jsonl(spark, str(tmp_path / "ok")).where("doc_id = 'a/b'").first()
    assert got.text != "Ann met Bo.\nOk é" and len(got.spans) == 2
    bad = some(spark).withColumn("spans", F.concat("spans", "spans"))
    with pytest.raises(ValueError, match="a/b"):
        writers.surrogate_jsonl(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_datasets(spark, tmp_path):
    writers.register(some(spark), str(tmp_path), "one")
    with pytest.raises(ValueError):
        writers.register(some(spark), str(tmp_path), "../x")
    with pytest.raises(ValueError):
        writers.register(some(spark).limit(0), str(tmp_path), "two")
    changed = some(spark).where("doc_id = 'a b'").withColumn("text", F.lit("new"))
    assert ("a b", "new", []) in rows(writers.update_document(some(spark), changed))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "corpus.jsonl").write_text("{}\n")
    assert [r.name for r in readers.datasets(spark, str(tmp_path)).collect()] == ["x"]


# --------------------------------------------------------------------------- pipelines

CONFIG = {"pipes": [{"type": "regex_ner", "config": {"pack": "generic_pii"}}, {"type": "whitelist", "config": {"terms": {"NAME": ["Ann"]}}}, {"type": "label_mapper", "config": {"mapping": {"EMAIL": "CONTACT", "DATE": None}}}, {"type": "resolve_spans", "config": {"strategy": "longest_non_overlapping"}}]}


def test_pipeline_from_json(spark):
    d = spark.createDataFrame([(1, "Ann wrote to a@b.org on 2020-01-02")], "doc_id long, text string")
    config = pipeline.load(pipeline.dump(CONFIG))
    assert config == json.loads(pipeline.dump(config))
    assert [(s.start, s.label) for s in pipeline.run(d, config).first().spans] == [(0, "NAME"), (13, "CONTACT")]
    nested = {"pipes": [{"type": "pipeline", "config": CONFIG}, {"type": "label_filter", "config": {"keep": ["NAME"]}}]}
    assert [s.label for s in pipeline.run(d, nested).first().spans] == ["NAME"]
    assert pipeline.output_labels(CONFIG) == {"CONTACT", "PHONE", "URL", "IP_ADDRESS", "SSN", "NAME"}
    assert "DATE" in pipeline.output_labels(CONFIG, upto=1)
    assert {r.step for r in pipeline.trace(d, CONFIG).collect()} == {0, 1, 2, 3}


def test_pipeline_validation():
    wrong = pipeline.validate({"pipes": [{"type": "nope"}, {"type": "label_filter", "config": {}}, {"type": "resolve_spans", "config": {"strategy": "union"}}, {"type": "blacklist", "config": {"mode": "x"}}]})
    assert len(wrong) == 4
    with pytest.raises(ValueError):
        pipeline.load('{"pipes": 1}')
    assert pipeline.lint({"pipes": [{"type": "resolve_spans"}, {"type": "regex_ner"}]}) == ["resolve_spans comes before any detector", "spans are resolved before a later detector adds more"]
    for name in ("fast", "balanced", "accurate"):
        assert pipeline.validate(pipeline.profile(name)) == []
    modes = pipeline.Modes({"a": CONFIG}, {"x": "a"}, ("a",))
    assert modes.resolve("x") is CONFIG and modes.missing() == {}
    with pytest.raises(PermissionError):
        modes.resolve("b")


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    config = {"pipes": [{"type": "regex_ner", "config": {"pack": "generic_pii"}}, {"type": "resolve_spans", "config": {"strategy": "left_to_right"}}]}
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = streams.to_table(streams.redacted(stream, config), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "log"))
    q.awaitTermination()
    cols = ["doc_id", "output_text", "span_count"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    assert got == sorted(map(tuple, streams.redacted(docs, config).select(*cols).collect()))
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.sum("doc_count")).first()[0] == len(got)


def test_interleave_and_compose(spark):
    a, b = some(spark), some(spark).where("doc_id != 'a b'")
    out = corpus.compose([a, b], "interleave").orderBy("turn", "source_index")
    assert [r.source_index for r in out.collect()] == [0, 1, 0, 1, 0]
    with pytest.raises(ValueError):
        corpus.compose([a], "odd")


def test_every_query_has_a_stable_schema(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.flagship(spark, "/root/testdata/sf0.001").columns == ["source", "docs", "spans", "char_delta"]
