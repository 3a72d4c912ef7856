"""Formats whose records span lines, read in Spark's own blocks: what a block begins in follows from sums, or maps of states,
over the blocks before it; each task then cuts its lines into records, and only pieces at the borders of blocks are joined."""

from __future__ import annotations

import csv
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = 2000


def block_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line): the lines of files, in order within a task, and where their block begins."""
    return spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))


def with_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines with their block's state; a row of some 100 bytes for each block is broadcast, a millionth of its text."""
    return lines.join(F.broadcast(states), ["path", "block"])


def in_runs(batches, columns: list[str]):
    """(whether a new block begins, path, block, slice of each column) for each run of a block's lines."""
    current = None
    for batch in batches:
        path, block = batch.column("path").to_pylist(), batch.column("block").to_pylist()
        values = {c: batch.column(c) for c in columns}
        at = 0
        while at < len(path):
            end = at + 1
            while end < len(path) and block[end] == block[at] and path[end] == path[at]:
                end += 1
            yield (path[at], block[at]) != current, path[at], block[at], {c: v.slice(at, end - at) for c, v in values.items()}
            current, at = (path[at], block[at]), end


# --------------------------------------------------------------------------- quoted records

PIECES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()), ("text", pa.string())])
PIECES_SQL = "path string, block long, seq long, left boolean, right boolean, text string"


def cut_records(batches):
    """Records of lines: one ends with a line after which the count of quotes is even. ``left`` and ``right``: pieces of a
    record that the block before began, or the block after goes on with."""
    rows, held = [], []
    state = {"inside": 0, "left": False, "seq": 0, "at": None}

    def emit(text, right):
        rows.append({"path": state["at"][0], "block": state["at"][1], "seq": state["seq"], "left": state["left"], "right": right, "text": text})
        state["seq"] += 1
        state["left"] = False

    for fresh, path, block, c in in_runs(batches, ["line", "quotes", "inside"]):
        if fresh:
            if held:
                emit("\n".join(held), True)
            held, inside = [], int(c["inside"][0].as_py())
            state |= {"inside": inside, "left": bool(inside), "seq": 0, "at": (path, block)}
        lines = c["line"].to_pylist()
        parity = (state["inside"] + np.cumsum(c["quotes"].to_numpy())) % 2
        begin = 0
        for end in np.flatnonzero(parity == 0).tolist():
            emit("\n".join(held + lines[begin : end + 1]), False)
            held, begin = [], end + 1
        held += lines[begin:]
        state["inside"] = int(parity[-1])
        if len(rows) >= ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema=PIECES)
            rows = []
    if held:
        emit("\n".join(held), True)
    yield pa.RecordBatch.from_pylist(rows, schema=PIECES)


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(path, block, seq, text): the records of files whose fields may hold line ends between quotes, in order by path, block
    and seq; empty lines are left out.

    The number of quotes before a block tells whether it begins within a field. It comes from sums over blocks, so a
    file of any size is read by as many tasks as it has blocks; texts are not shuffled, but for records that go over
    the border of blocks.
    """
    lines = block_lines(spark, path).withColumn("quotes", (F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))).cast("long"))
    sums = lines.groupBy("path", "block").agg(F.sum("quotes").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    states = sums.select("path", "block", (before % 2).cast("int").alias("inside"))
    pieces = with_states(lines, states).select("path", "block", "line", "quotes", "inside").mapInArrow(cut_records, PIECES_SQL)
    parts = pieces.where("left OR right")
    number = F.sum(F.when(F.col("left"), 0).otherwise(1)).over(W.partitionBy("path").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    of = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    joined = parts.withColumn("record", number).groupBy("path", "record").agg(of.alias("of")).select("path", F.col("of")[0]["block"].alias("block"), F.col("of")[0]["seq"].alias("seq"), F.array_join(F.transform("of", lambda x: x["text"]), "\n").alias("text"))
    return pieces.where("NOT left AND NOT right").select("path", "block", "seq", "text").unionByName(joined).where("text != ''")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of text columns from CSV files with a header each, quotes doubled within quotes, read in blocks. Files whose
    headers differ fail."""
    records = quoted_records(spark, path)
    is_header = (F.col("block") == 0) & (F.col("seq") == 0)
    headers = [r[0] for r in records.where(is_header).select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError("the files have different headers")
    if not headers:
        return spark.createDataFrame([], "path string")
    names = next(csv.reader([headers[0].lstrip("﻿")]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return records.where(~is_header).select(F.from_csv("text", schema, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")


# --------------------------------------------------------------------------- sections

#: Kinds of line: the two markers, a blank one, any other. States: outside, in a query, in its tags.
QUERY, TAGS, BLANK = 1, 2, 3
NEXT = {QUERY: (1, 1, 1), TAGS: (0, 2, 2), BLANK: (0, 1, 0)}
MAPS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
SECTIONS = pa.schema([("number", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("whole", pa.bool_()), ("tagged", pa.bool_()), ("text", pa.string()), ("tags", pa.list_(pa.string()))])


def kind_of(line: Column) -> Column:
    return F.when(line.rlike(r"^\s*===QUERY===\s*$"), QUERY).when(line.rlike(r"^\s*===PHI_TAGS===\s*$"), TAGS).when(line.rlike(r"^\s*$"), BLANK).otherwise(0)


def state_maps(batches):
    """For each block, from each state that it may begin in: the state it ends in, and the queries whose tags begin."""
    rows, current = [], None
    for fresh, path, block, c in in_runs(batches, ["kind"]):
        if fresh:
            current = {"path": path, "block": block, "ends": [0, 1, 2], "counts": [0, 0, 0]}
            rows.append(current)
        kinds = c["kind"].to_numpy()
        for k in kinds[kinds > 0].tolist():
            for s in range(3):
                current["counts"][s] += k == TAGS and current["ends"][s] == 1
                current["ends"][s] = NEXT[k][current["ends"][s]]
    yield pa.RecordBatch.from_pylist(rows, schema=MAPS)


def cut_sections(batches):
    """The queries and tags of each record, or of its part in a block."""
    rows, state, done = [], 0, 0
    at, query, tags, tagged, began = None, [], [], False, False

    def emit(number, whole):
        nonlocal query, tags, tagged
        rows.append({"number": number, "path": at[0], "block": at[1], "whole": whole, "tagged": tagged, "text": "\n".join(query) if query else None, "tags": tags})
        query, tags, tagged = [], [], False

    def close():
        if at and state:
            emit(done + 1 if state == 1 else done, False)

    for fresh, path, block, c in in_runs(batches, ["line", "kind", "state", "done"]):
        if fresh:
            close()
            at, state, done = (path, block), c["state"][0].as_py(), c["done"][0].as_py()
            query, tags, tagged, began = [], [], False, False
        for line, kind in zip(c["line"].to_pylist(), c["kind"].to_pylist()):
            new = NEXT[kind][state] if kind else state
            if state == 1:
                if kind == TAGS:
                    done, tagged = done + 1, True
                else:
                    query.append(line)
            elif state == 2:
                if new != 2:
                    emit(done, began)
                elif kind == 0 and line.lstrip().startswith("{"):
                    tags.append(line)
            if kind == QUERY and state != 1:
                began = True
            state = new
        if len(rows) >= ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema=SECTIONS)
            rows = []
    close()
    yield pa.RecordBatch.from_pylist(rows, schema=SECTIONS)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(number, text, tags array<string>): records of a query and its tags, numbered from 1 over all files in order of their
    paths. A query goes on to the line of its tags' marker, which end with a blank line or the next query; one without that marker
    is no record.

    A block's effect is a map from the state it begins in to the one it ends in and the records begun; these maps are
    composed along each file, so that each block's lines are read by a task of their own.
    """
    lines = block_lines(spark, path).withColumn("kind", kind_of(F.col("line")))
    maps = lines.select("path", "block", "kind").mapInArrow(state_maps, "path string, block long, ends array<int>, counts array<long>")
    of = F.array_sort(F.collect_list(F.struct("block", "ends", "counts")))
    zero = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("done"), F.array().cast("array<struct<block:long,state:int,done:long>>").alias("out"))

    def step(acc, m):
        begins = F.struct(m["block"].alias("block"), acc["state"].alias("state"), acc["done"].alias("done"))
        return F.struct(F.get(m["ends"], acc["state"]).alias("state"), (acc["done"] + F.get(m["counts"], acc["state"])).alias("done"), F.concat(acc["out"], F.array(begins)).alias("out"))

    files = maps.groupBy("path").agg(of.alias("of")).select("path", F.aggregate("of", zero, step).alias("a"))
    earlier = F.coalesce(F.sum("a.done").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    states = files.withColumn("earlier", earlier).select("path", "earlier", F.explode("a.out").alias("s")).select("path", "s.block", "s.state", (F.col("s.done") + F.col("earlier")).alias("done"))
    found = with_states(lines, states).select("path", "block", "line", "kind", "state", "done").mapInArrow(cut_sections, "number long, path string, block long, whole boolean, tagged boolean, text string, tags array<string>")
    pieces = F.array_sort(F.collect_list(F.struct("block", "text", "tags")))
    # a query without tags has the number of the next record, which begins in another file
    parts = found.where("NOT whole").groupBy("path", "number").agg(pieces.alias("of"), F.max("tagged").alias("tagged"))
    joined = parts.select("number", F.array_join(F.transform("of", lambda x: x["text"]), "\n").alias("text"), F.flatten(F.transform("of", lambda x: x["tags"])).alias("tags"), "tagged")
    whole = found.where("whole").select("number", F.coalesce("text", F.lit("")).alias("text"), "tags", "tagged")
    return whole.unionByName(joined).where("tagged").drop("tagged")


# --------------------------------------------------------------------------- sentences


def named_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of files behind where their block begins and its path, parted by line ends; one column passes to Arrow in half
    the time of three."""
    name = [F.input_file_block_start().cast("string"), F.lit("\n"), F.input_file_name(), F.lit("\n")]
    return spark.read.text(path, lineSep="\n").select(F.concat(*name, "value").alias("line"))


def first_bytes(texts: pa.Array) -> bytes:
    return texts.slice(0, 1).view(pa.binary())[0].as_py()


def without_first(texts: pa.Array, size: int) -> pa.Array:
    """Texts without their first ``size`` bytes."""
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(at) - size
    new = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.frombuffer(values, np.uint8)[np.repeat(at[:-1] + size - new[:-1], sizes) + np.arange(new[-1])]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(new), pa.py_buffer(data))


def in_named_runs(batches):
    """(name of the block, its lines without it) for each run of a block's lines."""
    for batch in batches:
        lines = batch.column(0)
        while len(lines):
            first = first_bytes(lines)
            name = first[: first.index(b"\n", first.index(b"\n") + 1) + 1]
            other = pc.index(pc.starts_with(lines.view(pa.binary()), name), False).as_py()
            own = lines if other < 0 else lines.slice(0, other)
            yield name, without_first(own, len(name))
            lines = lines.slice(len(own))


def cut_sentences(column: int):
    """Tokens, the cells of a column, joined by blanks between lines that part sentences: blank ones and -DOCSTART-. What stands before
    a block's first such line and after its last one are pieces, null if that is nothing, so that each block says where it parts
    sentences."""

    def tokens(lines, gap):
        cells = pc.ascii_split_whitespace(lines, max_splits=column + 1 if column >= 0 else -1)
        begin, end = cells.offsets.to_numpy()[:-1][~gap], cells.offsets.to_numpy()[1:][~gap]
        at = column + (begin if column >= 0 else end)
        if ((at < begin) | (at >= end)).any():
            raise ValueError(f"a line has no column {column}")
        return cells.values.take(pa.array(at))

    def run(batches):
        name, seq, left, held = None, 0, True, []

        def rows(texts, left, right):
            nonlocal seq
            seq, n = seq + len(texts), len(texts)
            block, path = name[:-1].decode().split("\n")
            same = {"path": path, "block": int(block), "left": left, "right": right}
            columns = {k: pa.repeat(pa.scalar(v, PIECES.field(k).type), n) for k, v in same.items()}
            return pa.RecordBatch.from_pydict(columns | {"seq": np.arange(seq - n, seq), "text": texts}, schema=PIECES)

        def piece(right):
            return rows(pa.array([b" ".join(held) if held else None], pa.binary()).view(pa.string()), left, right)

        for own, lines in in_named_runs(batches):
            if own != name:
                if name:
                    yield piece(True)
                name, seq, left, held = own, 0, True, []
            gap = pc.or_(pc.equal(pc.binary_length(pc.ascii_trim(lines, " ")), 0), pc.starts_with(lines, "-DOCSTART-")).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(gap)
            bounds = np.concatenate([[0], np.cumsum(~gap)[ends], [len(gap) - len(ends)]]).astype(np.int32)
            some = np.diff(bounds) > 0
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), tokens(lines, gap)), " ")
            if some[0]:
                held.append(first_bytes(texts))
            if len(ends):
                if left or held:
                    yield piece(False)
                left, held = False, [first_bytes(texts.slice(len(ends)))] if some[-1] else []
                yield rows(texts.slice(1, len(ends) - 1).filter(pa.array(some[1:-1])), False, False)
        if name:
            yield piece(True)

    return run


def sentence_counts(spark: SparkSession, path: str, of: Callable[[Column], Column], column: int = 0) -> DataFrame:
    """(value, n): how many sentences of tag files have each value of ``of``, a function of their tokens, joined by blanks.

    One scan. A sentence's value is found where it is read, and equal ones are counted there, so no text is shuffled but the pieces of
    sentences at the borders of blocks, two a block. These are put together within their file."""
    whole = ~F.col("left") & ~F.col("right")
    part = [F.when(~whole, F.col(c)).alias(c) for c in ("path", "block", "seq", "left", "text")]
    counted = named_lines(spark, path).mapInArrow(cut_sentences(column), PIECES_SQL).select(F.when(whole, of(F.col("text"))).alias("value"), *part).groupBy("value", "path", "block", "seq", "left", "text").agg(F.count("*").alias("n"))
    # whole sentences have no path and one row each here, pieces one row and no value
    number = F.sum(F.when(F.col("left"), 0).otherwise(1)).over(W.partitionBy("value", "path").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    records = counted.withColumn("record", number).groupBy("value", "path", "record").agg(pieces.alias("of"), F.max("n").alias("n"))
    records = records.where(F.col("path").isNull() | F.exists("of", lambda x: x["text"].isNotNull()))
    joined = F.array_join(F.transform("of", lambda x: x["text"]), " ")
    return records.groupBy(F.when(F.col("path").isNull(), F.col("value")).otherwise(of(joined)).alias("value")).agg(F.sum("n").alias("n"))
