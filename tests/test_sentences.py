"""Finding F1 of round 4: sentences of tag files are cut and counted where they are read, whatever the blocks."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from annolake.plans import catalog_more
from annolake.plans.catalog import ORACLES
from annolake.sources import blocks, readers


def plain(text):
    """The sentences of a tag file, line by line."""
    out, held = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip(" ") == "" or line.startswith("-DOCSTART-"):
            out, held = out + [" ".join(held)] * bool(held), []
        else:
            held.append("" if line[0] in " \t" else line.split()[0])
    return out


def counts(spark, path, **more):
    return {r.value: r.n for r in readers.conll_sentence_counts(spark, path, lambda x: x, **more).collect()}


ODD = ["\n\n\n\n\n", "a O\n\n\n\n\nb O", "-DOCSTART- x", "a O", " e", "", "\n".join(["long O"] * 60)]


def random_text(rng):
    kinds = ["", "", "  ", "-DOCSTART- -X- O O", "a O", "bc B-X", "é\U0001f600 O", "dddddddddddd\tI-X", " e O"]
    return "\n".join(rng.choice(kinds[rng.choice([0, 4]) :]) for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "\n\n\n\n\n"])


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_lines_of_any_blocks_and_batches(batch):
    """Tasks by themselves: the pieces of blocks, put together, are the sentences of their files."""
    import pyarrow as pa

    rng = random.Random(batch)
    for text in [*ODD, *(random_text(rng) for _ in range(60))]:
        lines, named, block = text.split("\n"), [], 0
        for i, x in enumerate(lines):
            block = i if rng.random() < 0.2 else block
            named.append(f"{block}\nfile:/a:b/c%20\n{x}")
        batches = [pa.RecordBatch.from_arrays([pa.array(named[i : i + batch])], ["line"]) for i in range(0, len(named), batch)]
        rows = [r for b in blocks.cut_sentences(0)(iter(batches)) for r in b.to_pylist()]
        assert len({(r["block"], r["seq"]) for r in rows}) == len(rows) and {r["path"] for r in rows} == {"file:/a:b/c%20"}
        got, held = [], []
        for r in sorted(rows, key=lambda r: (r["block"], r["seq"])):
            assert r["text"] is not None or r["left"] or r["right"]
            if not r["left"]:
                got, held = got + [" ".join(held)] * bool(held), []
            held += [] if r["text"] is None else [r["text"]]
        assert got + [" ".join(held)] * bool(held) == plain(text)


def test_sentences_over_borders_of_blocks(spark, tmp_path):
    rng = random.Random(4)
    texts = [*ODD, *(random_text(rng) for _ in range(8))]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_text(text)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        for block in (31, 200):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            assert counts(spark, str(tmp_path)) == Counter(x for text in texts for x in plain(text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    rows = readers.conll_sentences(readers.conll(spark, str(tmp_path)))
    assert counts(spark, str(tmp_path)) == {r.line: r["count"] for r in rows.groupBy("line").count().collect()}


def test_other_columns(spark, tmp_path):
    (tmp_path / "own.txt").write_bytes(b"1 a X\n2  b \tY\n\n3 \xe9 Z\n")
    assert counts(spark, str(tmp_path), token_column=-2) == {"a b": 1, "�": 1}
    (tmp_path / "own.txt").write_text("1 a X\n2")
    with pytest.raises(Exception, match="has no column 1"):
        counts(spark, str(tmp_path), token_column=1)


def test_texts_of_tag_files_are_not_shuffled(spark, tmp_path):
    rows = [(1, "Anned walk the abced", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, "x\n\n y", "en", "s"), (5, "x y", "en", "s"), (6, "z", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog_more.conll_texts(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(ORACLES["conll_texts"]).fetchall())
    assert plan.count("Relation") == 1 and "Join" not in plan  # one scan, and what is grouped are values of sentences, not lines
    assert plan.index("MapInArrow") > plan.rindex("Aggregate")
