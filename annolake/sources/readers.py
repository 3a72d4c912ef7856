"""Readers of annotated corpora (SURVEY A). All go through Spark's own file sources, so any path Spark opens will do."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.text import find_all
from annolake.operators.paging import page
from annolake.schema import SPANS, no_spans, outside
from annolake.sources.blocks import csv_table, sections, sentence_counts
from annolake.sources.scratch import mounted_or_none

SPLITS = ("train", "valid", "test", "dev", "deploy")
ANNOTATED = f"document struct<id:string,text:string,metadata:map<string,string>>, spans {SPANS}"


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, doc_id, text, metadata, spans, message): one row for each line that isn't blank, numbered from 1 in its
    file; ``message`` says what is wrong with it, null if nothing is."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("d", F.from_json("line", f"{ANNOTATED}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    d = parsed.select("path", (F.col("i") + 1).alias("line"), "d.document", F.coalesce("d.spans", no_spans()).alias("spans"), F.col("d.__bad").alias("bad"), F.get_json_object("line", "$").isNull().alias("broken"))
    d = d.select("path", "line", F.col("document.id").alias("doc_id"), F.col("document.text").alias("text"), F.coalesce("document.metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "spans", "bad", "broken")
    said = lambda x: F.concat(F.lit("not a valid document: "), F.lit(x))
    lacks = F.exists("spans", lambda s: s["start"].isNull() | s["end"].isNull() | s["label"].isNull())
    message = F.when(F.col("broken"), F.lit("invalid JSON")).when(F.col("bad").isNotNull(), said("a field is of another type")).when(F.col("doc_id").isNull(), said("id is missing")).when(F.col("text").isNull(), said("text is missing")).when(lacks, said("a span lacks start, end or label")).when(F.exists("spans", outside), said("a span exceeds the text"))
    return d.withColumn("message", message).drop("bad", "broken")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A1: one annotated document a line; blank lines are skipped, a bad one fails the read with its number."""
    d = jsonl_lines(spark, path)
    fail = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("message"), F.lit(" in "), F.col("path")))
    return d.withColumn("spans", F.when(F.col("message").isNull(), F.col("spans")).otherwise(fail.cast(SPANS))).select("doc_id", "text", "metadata", "spans")


def jsonl_aside(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1, 2.O: the good documents of a file or folder, and (path, line, doc_id, message) of the bad lines, which don't end
    the run."""
    d = jsonl_lines(spark, path)
    return d.where("message IS NULL").select("doc_id", "text", "metadata", "spans"), d.where("message IS NOT NULL").select("path", "line", "doc_id", "message")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over the cores if its files give tasks to a quarter of them at most: a file of one row group is read by
    one task, whatever its size. Other tables stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


#: Blocks whose first line numbers may be broadcast; those of more are joined.
BROADCAST_BLOCKS = 500_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, i, line): the lines of files and their numbers from 0, blank lines counted.

    Files are read in blocks as Spark splits them. A task numbers its rows as it reads them; a line's number is its
    distance from the first of its block and the lines of the blocks before. These are counted first, without the
    texts, which are not shuffled.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    sums = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = sums.select("path", "block", (before - F.col("first")).alias("shift")).persist()
    few = firsts.count() <= BROADCAST_BLOCKS
    return lines.join(F.broadcast(firsts) if few else firsts, ["path", "block"]).select("path", "block", (F.col("at") + F.col("shift")).alias("i"), "line")


def _counted(lines: DataFrame, what: Column, name: str) -> DataFrame:
    """Adds the sum of ``what`` over a file's lines up to each, from sums of blocks and sums in a block."""
    sums = lines.groupBy("path", "block").agg(F.sum(what).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum(what).over(W.partitionBy("path", "block").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = lines.withColumn("__upto", upto).join(sums.select("path", "block", before.alias("__before")), ["path", "block"])
    return joined.withColumn(name, F.col("__before") + F.col("__upto")).drop("__before", "__upto")


def _files_with_empty(spark: SparkSession, path: str) -> DataFrame:
    """As _files, empty files too, which Spark's table sources, binaryFile too, pass over: an .ann file without a line is a
    document without spans. Paths aren't encoded here."""
    sc = spark.sparkContext
    return spark.createDataFrame(sc.wholeTextFiles(path, sc.defaultParallelism), "path string, content string")


def _name(path: Column, encoded: bool = True) -> Column:
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.url_decode(name) if encoded else name


def brat_spans(content: Column) -> Column:
    """A2: the T lines of an .ann file; discontinuous ones and ones without whole offsets are left out."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^T[^\t]*\t\S+ -?[0-9]+ -?[0-9]+(?:\t|$)"))

    def span(x):
        part = lambda i: F.regexp_extract(x, r"^T[^\t]*\t(\S+) (-?[0-9]+) (-?[0-9]+)", i)
        return F.struct(part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), part(1).alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("brat").alias("source"))

    return F.transform(lines, span).cast(SPANS)


#: Bytes and documents of one batch of files read.
PAIR_BYTES, PAIR_ROWS = 8_000_000, 1000


def _pairs(spark: SparkSession, folders: list[str], suffix: str, places) -> DataFrame:
    """(folder, stem, text, ann) of mounted folders' documents, read by tasks: each lists the names that end in ``suffix`` and
    takes those whose checksum is its own, so names don't pass through the driver and no file is a task. ``places``:
    folder and stem to the paths of text and annotations; a document that lacks either is left out."""
    n = 4 * spark.sparkContext.defaultParallelism

    def read(batches):
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            rows, held = [], 0
            for folder in folders:
                for entry in os.scandir(folder) if os.path.isdir(folder) else ():
                    name = entry.name
                    if name[0] in "._" or not name.endswith(suffix) or zlib.crc32(name.encode("utf-8", "surrogateescape")) % n != k:
                        continue
                    stem = name[: len(name) - len(suffix)]
                    both = []
                    for at in places(folder, stem):
                        if at and os.path.isfile(at):
                            with open(at, "rb") as f:
                                both.append(f.read().decode("utf-8", "replace"))
                    if len(both) == 2:
                        rows.append((folder, stem, *both))
                        held += len(both[0]) + len(both[1])
                    if held > PAIR_BYTES or len(rows) >= PAIR_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], ["folder", "stem", "text", "ann"])
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], ["folder", "stem", "text", "ann"])

    return spark.range(0, n, 1, n).mapInArrow(read, "folder string, stem string, text string, ann string")


def _local(path: str) -> str | None:
    """A mounted folder's path; none of other file systems and of patterns of names."""
    at = mounted_or_none(path)
    return at if at and os.path.isdir(at) else None


def _beside(folder: str, stem: str) -> list[str]:
    return [os.path.join(folder, f"{stem}.{ext}") for ext in ("txt", "ann")]


def brat(spark: SparkSession, path: str, prefix: str = "", split: str | None = None) -> DataFrame:
    """Each .txt with the .ann of the same stem; texts without one are left out. ids are prefix and stem."""
    meta = F.create_map(F.lit("split"), F.lit(split)) if split else F.create_map().cast("map<string,string>")
    if at := _local(path):
        both = _pairs(spark, [at], ".txt", _beside).withColumn("spans", brat_spans(F.col("ann")))
    else:
        stem = lambda ext: F.regexp_replace(_name(F.col("path"), False), rf"\.{ext}$", "")
        texts = _files_with_empty(spark, f"{path}/*.txt").select(stem("txt").alias("stem"), F.col("content").alias("text"))
        both = texts.join(_files_with_empty(spark, f"{path}/*.ann").select(stem("ann").alias("stem"), brat_spans(F.col("content")).alias("spans")), "stem")
    return both.select(F.concat(F.lit(prefix), "stem").alias("doc_id"), "text", meta.alias("metadata"), "spans")


def brat_parts(spark: SparkSession, path: str) -> DataFrame:
    """A3 of what writers.brat writes: a folder for each stem, whose one part file is the text, or the annotations."""
    if at := _local(f"{path}/txt"):
        def places(folder, stem):
            found = []
            for kind in (folder, os.path.join(os.path.dirname(folder), "ann")):
                own = os.path.join(kind, stem)
                names = [x for x in (os.listdir(own) if os.path.isdir(own) else ()) if x.endswith(".txt") and x[0] not in "._"]
                found.append(os.path.join(own, names[0]) if names else None)
            return found

        stem = F.url_decode(F.regexp_extract("stem", r"^stem=(.+)$", 1))
        both = _pairs(spark, [at], "", places).where("stem LIKE 'stem=%'").select(stem.alias("doc_id"), F.col("text").alias("content"), brat_spans(F.col("ann")).alias("spans"))
    else:
        stem = F.url_decode(F.regexp_extract("path", r"/stem=([^/]+)/", 1))
        anns = _files(spark, f"{path}/ann/*/*.txt").select(stem.alias("doc_id"), brat_spans(F.col("content")).alias("spans"))
        both = _files(spark, f"{path}/txt/*/*.txt").select(stem.alias("doc_id"), "content").join(anns, "doc_id")
    return both.select("doc_id", F.regexp_replace("content", r"\n\z", "").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), "spans")


def brat_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A4: subfolders named as splits give metadata.split and ids {split}__{stem}; without any, the folder itself."""
    if at := _local(path):
        folders = [os.path.join(at, x) for x in SPLITS if os.path.isdir(os.path.join(at, x))]
        if not any(e.name.endswith(".txt") for x in folders for e in os.scandir(x)):
            return brat(spark, path)
        both = _pairs(spark, folders, ".txt", _beside).select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("split"), "stem", "text", brat_spans(F.col("ann")).alias("spans"))
    elif not _has_splits(spark, path):
        return brat(spark, path)
    else:
        below = lambda ext: _files_with_empty(spark, f"{path}/{{{','.join(SPLITS)}}}/*.{ext}")
        key = lambda ext: [F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("split"), F.regexp_replace(_name(F.col("path"), False), rf"\.{ext}$", "").alias("stem")]
        both = below("txt").select(*key("txt"), F.col("content").alias("text")).join(below("ann").select(*key("ann"), brat_spans(F.col("content")).alias("spans")), ["split", "stem"])
    return both.select(F.concat_ws("__", "split", "stem").alias("doc_id"), "text", F.create_map(F.lit("split"), F.col("split")).alias("metadata"), "spans")


def _has_splits(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return not files.select("path").where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).isin(list(SPLITS))).isEmpty()


def load(spark: SparkSession, jsonl_path: str | None = None, brat_dir: str | None = None, brat_split_dir: str | None = None) -> DataFrame:
    """A5: exactly one kind of source."""
    given = [(f, p) for f, p in ((jsonl, jsonl_path), (brat, brat_dir), (brat_corpus, brat_split_dir)) if p]
    if len(given) != 1:
        raise ValueError("give exactly one source")
    return given[0][0](spark, given[0][1])


def load_spec(spark: SparkSession, spec: str) -> DataFrame:
    """``jsonl:path``, ``brat-dir:path`` or ``brat-corpus:path``."""
    kind, sep, path = spec.partition(":")
    readers = {"jsonl": jsonl, "brat-dir": brat, "brat-corpus": brat_corpus}
    if not sep or kind not in readers or not path.strip():
        raise ValueError(f"not a source: {spec!r}; known kinds: {sorted(readers)}")
    return readers[kind](spark, path.strip())


def production_export(spark: SparkSession, path: str) -> DataFrame:
    """Exports of schema_version 1; blank ids become ``doc``, confidences that are no numbers null."""
    raw = "schema_version int, id string, text string, source_label string, output_type string, resolved boolean, metadata map<string,string>, spans array<struct<start:int,end:int,label:string,confidence:string,source:string>>"
    d = spark.read.schema(raw).json(path, mode="FAILFAST")
    version = F.when(F.coalesce("schema_version", F.lit(0)) != 1, F.raise_error(F.lit("schema_version must be 1"))).otherwise(F.lit(1))
    extra = F.map_filter(F.create_map(F.lit("source_label"), F.col("source_label"), F.lit("export_output_type"), F.col("output_type"), F.lit("export_resolved"), F.col("resolved").cast("string")), lambda k, v: v.isNotNull())
    base = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(extra, k))
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["confidence"].try_cast("double").alias("confidence"), s["source"].alias("source"))
    return d.withColumn("v", version).where("v = 1").select(F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.lit("doc")).alias("doc_id"), "text", F.map_concat(base, extra).alias("metadata"), F.coalesce(F.transform("spans", span), no_spans()).alias("spans"))


def align_tags(text: Column, tags: Column) -> Column:
    """A span for each of array<struct<value, label>>: the first occurrence at or after the last one's end, else
    the first of all; values that don't occur give none."""
    state = F.struct(F.lit(0).alias("cursor"), no_spans().alias("out"))

    def step(acc, t):
        places = find_all(text, t["value"])
        later = F.array_min(F.filter(places, lambda p: p >= acc["cursor"]))
        start = F.coalesce(later, F.array_min(places))
        end = start + F.length(t["value"])
        span = F.struct(start.alias("start"), end.alias("end"), t["label"].alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("aligned").alias("source"))
        return F.when(start.isNull(), acc).otherwise(F.struct(end.alias("cursor"), F.array_append(acc["out"], span).alias("out")))

    return F.aggregate(tags, state, step)["out"].cast(SPANS)


def asq_phi(spark: SparkSession, path: str, prefix: str = "asq") -> DataFrame:
    """Records of ===QUERY=== and ===PHI_TAGS=== sections, tags one JSON object a line; bad tags are skipped. ids are
    {prefix}_{n}, n from 1 over all files in order of their paths."""
    tag = "struct<identifier_type:string,value:string>"
    parsed = F.filter(F.transform("tags", lambda x: F.from_json(x, tag)), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    tags = F.transform(parsed, lambda x: F.struct(x["value"].alias("value"), F.coalesce(x["identifier_type"], F.lit("UNKNOWN")).alias("label")))
    rows = sections(spark, path).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    meta = F.create_map(F.lit("source"), F.lit("ASQ-PHI"), F.lit("corpus"), F.lit("synthetic_clinical_queries"))
    return rows.select(F.concat(F.lit(f"{prefix}_"), F.col("number").cast("string")).alias("doc_id"), "text", meta.alias("metadata"), align_tags(F.col("text"), tags).alias("spans"))


def mimic_notes(spark: SparkSession, path: str) -> DataFrame:
    """A10: ROW_ID, CHARTDATE (three formats, else null) and TEXT of a note table; rows without text are left out. Files are
    read in blocks (blocks.quoted_records), one that holds all notes too."""
    d = csv_table(spark, path)
    if "TEXT" not in d.columns:
        return spark.createDataFrame([], "doc_id string, text string, chart_date date")
    column = lambda name: F.col(name) if name in d.columns else F.lit(None).cast("string")
    day = F.coalesce(*[F.try_to_timestamp(column("CHARTDATE"), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy")]).cast("date")
    return d.where("TEXT IS NOT NULL").select(column("ROW_ID").alias("doc_id"), F.col("TEXT").alias("text"), day.alias("chart_date"))


def raw_texts(spark: SparkSession, path: str, kind: str, with_stem: bool = True) -> DataFrame:
    """A folder of .txt files (``dir``), JSON lines with id or document.id (``jsonl``), or one file (``file``).
    A line without id is named {stem}_line_{i}, or line_{i}."""
    if kind in ("dir", "file"):
        files = _files(spark, f"{path}/*.txt" if kind == "dir" else path)
        return files.select(F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "").alias("doc_id"), F.col("content").alias("text"))
    lines = numbered_lines(spark, path).select(F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "").alias("stem"), "i", "line").where("trim(line) != ''")
    j = F.from_json("line", "struct<id:string,text:string,document:struct<id:string,text:string>>")
    name = F.concat(F.concat("stem", F.lit("_")) if with_stem else F.lit(""), F.lit("line_"), F.col("i").cast("string"))
    return lines.withColumn("j", j).select(F.coalesce("j.id", "j.document.id", name).alias("doc_id"), F.coalesce("j.text", "j.document.text").alias("text"))


def physionet(spark: SparkSession, text_path: str, ann_path: str) -> DataFrame:
    """Records between START_OF_RECORD= and END_OF_RECORD, newlines as blanks, with annotation rows
    (record_id, begin, length, type) that lie within them."""
    parts = spark.read.text(text_path, lineSep="||||END_OF_RECORD").where(F.contains("value", F.lit("START_OF_RECORD=")))
    rec = parts.select(F.regexp_replace("value", r"\|+\z", "").alias("b")).select(F.regexp_extract("b", r"START_OF_RECORD=([^|\n]+)", 1).alias("record_id"), F.translate(F.regexp_replace("b", r"(?s)^.*?START_OF_RECORD=[^\n]*\n?", ""), "\n", " ").alias("text"))
    ann = spark.read.csv(ann_path, header=True)
    span = F.struct(F.col("begin").cast("int").alias("start"), (F.col("begin").cast("int") + F.col("length").cast("int")).alias("end"), F.col("type").alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("physionet").alias("source"))
    by = ann.select("record_id", span.alias("s")).groupBy("record_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    inside = F.filter(F.coalesce("spans", no_spans()), lambda s: (s["start"] >= 0) & (s["end"] <= F.length("text")) & (s["start"] < s["end"]))
    return rec.join(by, "record_id", "left").select(F.col("record_id").alias("doc_id"), "text", inside.cast(SPANS).alias("spans"))


def sentence_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a sentence and its annotations, parted by a written-out \\t: ``LABEL: value`` or, after =>, a
    normal form that isn't used; each takes its value's first free place."""
    lines = numbered_lines(spark, path).where(F.contains("line", F.lit("\\t")))
    cells = F.split("line", r"\\t")
    raw = F.flatten(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.regexp_extract_all(c, F.lit(r"([A-Z_]+: [^;]+)"), F.lit(1))))
    tags = F.transform(raw, lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[A-Z_]+: ", ""), r"=>.*$", "")).alias("value"), F.regexp_extract(x, r"^([A-Z_]+):", 1).alias("label")))
    d = lines.withColumn("text", F.element_at(cells, 1)).withColumn("tags", tags)
    return d.select(F.concat(F.lit("line_"), F.col("i").cast("string")).alias("doc_id"), "text", align_tags(F.col("text"), F.col("tags")).alias("spans"))


def phrases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(term) of a list: txt with # comments, csv's first column (a header named term, phrase, value or name is
    left out), or json: a list, or an object with terms, items, values or names, else its string values."""
    if kind == "txt":
        out = spark.read.text(path).select(F.trim("value").alias("term")).where("NOT startswith(term, '#')")
    elif kind == "csv":
        out = spark.read.csv(path).select(F.trim("_c0").alias("term")).where("lower(term) NOT IN ('term', 'phrase', 'value', 'name', 'terms')")
    elif kind == "json":
        c = _files(spark, path)
        listed = F.from_json("content", "array<string>")
        obj = F.from_json("content", "struct<terms:array<string>,items:array<string>,values:array<string>,names:array<string>>")
        out = c.select(F.explode(F.coalesce(F.when(F.ltrim("content").startswith("["), listed), obj["terms"], obj["items"], obj["values"], obj["names"], F.map_values(F.from_json("content", "map<string,string>")))).alias("term")).select(F.trim("term").alias("term"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return out.where("term != ''").distinct()


def search_terms(terms: DataFrame, text: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the terms that hold ``text``, whatever the case."""
    return page(terms.where(F.contains(F.lower("term"), F.lit(text.lower()))), F.lower("term"), offset, limit, [F.col("term")])


def conll(spark: SparkSession, path: str, token_column: int = 0, label_column: int = -1, places: bool = True) -> DataFrame:
    """(file, n, sentence, token, tag) of lines of columns; blank and -DOCSTART- lines part sentences. Without ``places``
    (file, token, tag): lines are read once and not shuffled, as neither they nor sentences are numbered."""
    gap = (F.trim("line") == "") | F.startswith("line", F.lit("-DOCSTART-"))
    cells = F.split("line", r"\s+")
    at = lambda i: F.element_at(cells, i + 1 if i >= 0 else i)
    own = [at(token_column).alias("token"), at(label_column).alias("tag")]
    if not places:
        lines = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("path"), F.col("value").alias("line"))
        return lines.where(~gap).select(_name(F.col("path")).alias("file"), *own)
    lines = numbered_lines(spark, path).withColumnsRenamed({"i": "n"}).withColumn("at", F.col("n"))
    numbered = _counted(lines.withColumn("gap", gap), F.col("gap").cast("int"), "sentence")
    return numbered.where("NOT gap").select(_name(F.col("path")).alias("file"), "n", "sentence", *own)


def conll_sentences(rows: DataFrame) -> DataFrame:
    """(file, sentence, line): each sentence's tokens joined by blanks; no row holds a whole file."""
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    return rows.groupBy("file", "sentence").agg(F.array_join(tokens, " ").alias("line"))


def conll_sentence_counts(spark: SparkSession, path: str, of: Callable[[Column], Column], token_column: int = 0) -> DataFrame:
    """(value, n): how many lines of conll_sentences have each value of ``of``; files are read once and tokens not shuffled. A
    line without the column fails."""
    return sentence_counts(spark, path, of, token_column)


def conll_text(rows: DataFrame) -> DataFrame:
    """(file, text): the sentences of a file, joined by newlines."""
    text = conll_sentences(rows).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("sentence", "line"))).alias("s"))
    return text.select("file", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"))


def mismatches(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Annotations (doc_id, start, end, surface) whose surface differs from the text's, white space aside."""
    from annolake.functions.text import squeeze, surface

    j = surfaces.join(docs.select("doc_id", "text"), "doc_id")
    return j.withColumn("found", surface(F.col("text"), F.col("start"), F.col("end"))).where(squeeze(F.col("found")) != squeeze(F.col("surface"))).drop("text")


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, bytes) of the corpora below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "corpus.jsonl").load(root)
    return f.select(F.regexp_extract("path", r"([^/]+)/corpus\.jsonl$", 1).alias("name"), "path", F.col("length").alias("bytes")).orderBy("name")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of stored results or manifests; broken ones are left out, newest names first."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").withColumn("file", F.input_file_name()).orderBy(F.desc("file"))
