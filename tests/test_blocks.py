"""Records that span lines, read in small blocks, against readers that see whole files."""

import csv
import io
import random

import pytest

from annolake.sources import blocks, readers


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def note(rng):
    return "".join(rng.choice(['"', "\n", ",", "a", "bc", " ", '""', "\n\n", "é", "\t"]) for _ in range(rng.randint(0, 120)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_records_over_blocks(spark, tmp_path, small_blocks, end):
    rng = random.Random(3)
    want = []
    for f in range(3):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        w.writerow(["ROW_ID", "CHARTDATE", "TEXT"])
        for i in range(60):
            text = note(rng) * (20 if i == 7 else 1)  # one record of many blocks
            w.writerow([f"{f}-{i}", rng.choice(["2020-01-02", "2020-01-02 03:04:05", "01/02/2020", "", "soon"]), text])
            if text:
                want.append((f"{f}-{i}", text))
        (tmp_path / f"n{f}.csv").write_bytes(out.getvalue().encode())
    lines = blocks.block_lines(spark, str(tmp_path))
    assert lines.select("path", "block").distinct().count() > 40
    got = [(r.doc_id, r.text) for r in readers.mimic_notes(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("TEXT,ROW_ID\n")
    assert readers.mimic_notes(spark, str(tmp_path / "a")).count() == 0
    (tmp_path / "a" / "y.csv").write_text("ROW_ID,TEXT\n1,b\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.mimic_notes(spark, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("\n\nTEXT,ROW_ID\n\na,1\n")
    assert blocks.quoted_records(spark, str(tmp_path / "b")).count() == 2


def whole_file(text):
    """Records of one file, line by line."""
    out, query, tags, state = [], [], [], 0
    for line in text.split("\n"):
        s = line.strip()
        if state == 1:
            if s == "===PHI_TAGS===":
                state, tags = 2, []
            else:
                query.append(line)
        elif state == 2 and (s == "" or s == "===QUERY==="):
            out.append(("\n".join(query), tags))
            state = 0
        elif state == 2 and s.startswith("{"):
            tags.append(line)
        if state == 0 and s == "===QUERY===":
            state, query = 1, []
    return out + ([("\n".join(query), tags)] if state == 2 else [])


@pytest.mark.parametrize("seed", range(4))
def test_sections_over_blocks_and_files(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    want = []
    for f in range(3):
        lines = [rng.choice(["===QUERY===", "===QUERY===", "===PHI_TAGS===", "  ===PHI_TAGS=== ", "", "plain text", "more of it, longer", '{"identifier_type": "NAME", "value": "text"}', "{bad"]) for _ in range(400)]
        (tmp_path / f"q{f}.txt").write_text("\n".join(lines))
        want += whole_file("\n".join(lines))
    rows = sorted((r.number, r.text, list(r.tags)) for r in blocks.sections(spark, str(tmp_path)).collect())
    assert [r[0] for r in rows] == list(range(1, len(want) + 1))
    assert [(t, g) for _, t, g in rows] == want
    ids = [r.doc_id for r in readers.asq_phi(spark, str(tmp_path)).collect()]
    assert len(ids) == len(set(ids)) == len(want) > 20


def test_line_numbers_without_shuffled_texts(spark, tmp_path, small_blocks):
    for f in range(2):
        (tmp_path / f"{f}.txt").write_text("\n".join(f"{f} line {i}" if i % 7 else "" for i in range(500)) + "\n")
    df = readers.numbered_lines(spark, str(tmp_path))
    got = {(r.path[-5:], r.i): r.line for r in df.collect()}
    assert got == {(f"{f}.txt", i): (f"{f} line {i}" if i % 7 else "") for f in range(2) for i in range(500)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("InMemoryTableScan")[0]
