"""Settings, label spaces and rules that read no table."""

from annolake.operators import detect, output
from annolake.plans import fixtures, pipeline
from annolake.sources import stores

REGEX = {"type": "regex_ner", "config": {"pack": fixtures.PRED, "dedupe": False, "flags": ""}}


def test_pipelines_are_saved_renamed_and_deleted(spark, tmp_path):
    store = stores.Pipelines(spark, str(tmp_path / "p"))
    for name in ("fast", "balanced", "accurate"):
        store.put(name, pipeline.profile(name))
    store.rename("fast", "quick")
    store.delete("balanced")
    import json

    got = {r["name"]: [p["type"] for p in json.loads(r["config"])["pipes"]] for r in store.current().collect()}
    assert got == {n: [p["type"] for p in pipeline.profile(k)["pipes"]] for n, k in (("quick", "fast"), ("accurate", "accurate"))}


def test_label_algebra():
    config = {"pipes": [REGEX, {"type": "label_filter", "config": {"drop": ["ID"]}}, {"type": "label_mapper", "config": {"mapping": {"CITY": "LOCATION"}}}, {"type": "label_filter", "config": {"keep": ["DATE", "LOCATION", "X"]}}]}
    assert [",".join(sorted(pipeline.output_labels(config, upto=i))) for i in range(1, 5)] == ["CITY,DATE,EMAIL,ID,NAME", "CITY,DATE,EMAIL,NAME", "DATE,EMAIL,LOCATION,NAME", "DATE,LOCATION"]


def test_detector_labels():
    assert detect.label_space(["PER", "GPE", "NORP", "ORG"], built_in=("DATE_TIME",)) == ["DATE", "LOCATION", "NAME", "NRP", "ORGANIZATION"]
    assert detect.manifest_space({"labels": ["private_person", "d", "x"], "default_entity_map": {"private_person": "PERSON"}}, {"private_person": "NAME", "d": "DATE"}, {"x": None}) == ["DATE", "NAME"]
    assert (detect.segmentation("auto", "truncate"), detect.segmentation("auto", "sentence"), detect.segmentation("truncate", "sentence")) == ("chunk", "sentence", "truncate")
    m = detect.analyzer_mapping()
    assert sorted([m["US_SSN"], m["GPE"], m["HCW"], m["PHONE"]]) == ["ID", "LOCATION", "NAME", "PHONE"]


def test_placeholder_kinds(spark):
    want = {"Known firstname 1234": "first name", "2151-8-3": "full date", "8-3": "month day", "Hospital Ward 2": "hospital ward", "Age over 90 ": "age over 90", "May 2150": "month year", "Telephone/Fax (1) 88": "phone number", "71": "age", "2150": "year", "12345": "numeric id", "Street Address(2) ": "street address", "Name (NI) 5": "full name", "": "blank", "zz": "other"}
    df = spark.createDataFrame([(x,) for x in want], "content string")
    assert {r.content: r.kind for r in df.select("content", output.placeholder_kind(df["content"]).alias("kind")).collect()} == want


def test_one_bad_text_takes_none_of_its_neighbours_with_it(spark):
    from annolake.schema import aside

    def make():
        def found(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no such text")
            return [[(0, 1, "X", 0.5, "m")] for _ in texts]

        return found

    docs = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "well"), (4, None)], "doc_id int, text string").coalesce(1)
    rows = {r.doc_id: r for r in detect.external(docs, make, error="why").collect()}
    assert {i: (len(r.spans), r.why) for i, r in rows.items()} == {1: (1, None), 2: (0, "ValueError: no such text"), 3: (1, None), 4: (0, None)}
    good, errors = aside(detect.external(docs, make))
    assert sorted(r.doc_id for r in good.collect()) == [1, 2, 3] and [tuple(r) for r in errors.collect()] == [(4, "no text")]


def test_bad_lines_are_named(spark, tmp_path):
    import pytest

    from annolake.sources import readers

    good = '{"document": {"id": "a", "text": "abc"}, "spans": [{"start": 0, "end": 1, "label": "X"}]}'
    lines = [good, "", '{"document": {"id": "b", "text"', '{"document": {"id": "c"}}', '{"document": {"id": "d", "text": "x"}, "spans": [{"start": 0, "end": 9, "label": "X"}]}', '{"document": {"id": "e", "text": "x"}, "spans": [{"start": 0, "end": 1}]}', '{"document": {"id": "f", "text": "x"}, "spans": 5}', '{"document": {"text": "x"}}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    docs, errors = readers.jsonl_aside(spark, str(tmp_path / "x.jsonl"))
    assert [r.doc_id for r in docs.collect()] == ["a"]
    got = {r.line: (r.doc_id, r.message) for r in errors.collect()}
    say = "not a valid document: "
    assert got == {3: (got[3][0], "invalid JSON"), 4: ("c", say + "text is missing"), 5: ("d", say + "a span exceeds the text"), 6: ("e", say + "a span lacks start, end or label"), 7: (got[7][0], say + "a field is of another type"), 8: (None, say + "id is missing")}
    with pytest.raises(Exception, match="line [345678]: "):
        readers.jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def test_numbers_are_permuted_without_collisions(spark):
    from pyspark.sql import functions as F

    for n, all_of in ((4, 10**4), (5, 10**5)):
        df = spark.range(all_of).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        new = df.select("d", output.permuted(F.col("d"), F.lit(1)).alias("new"), output.permuted(F.col("d"), F.lit(2)).alias("other"))
        r = new.agg(F.countDistinct("new").alias("k"), F.max(F.length("new")).alias("most"), F.min(F.length("new")).alias("least"), F.sum((F.col("d") == F.col("new")).cast("int")).alias("same"), F.sum((F.col("other") == F.col("new")).cast("int")).alias("both")).first()
        assert (r.k, r.most, r.least) == (all_of, n, n) and r.same < 30 and r.both < 30
    long = spark.createDataFrame([(str(10**17 + i),) for i in range(500)], "d string")
    assert long.select(output.permuted(F.col("d"), F.lit(1)).alias("x")).where("length(x) = 18").distinct().count() == 500


def test_100000_names_share_no_stand_in(spark):
    from pyspark.sql import functions as F

    df = spark.range(100000).select(F.concat(F.lit("Person "), F.col("id").cast("string")).alias("said"))
    made = df.select(output.surrogate(F.lit("NAME"), F.col("said")).alias("new"))
    assert made.distinct().count() == 100000 and made.where(~F.col("new").rlike("^[A-Z][a-z]{5} [A-Z][a-z]{7}$")).count() == 0
