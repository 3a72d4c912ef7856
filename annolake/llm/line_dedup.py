"""Operator 10: line dedup. Two Bloom filters hold the hashes of lines seen once and seen twice; only lines that the
second one suspects are shuffled, for exact confirmation and the choice of the occurrence that stays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.llm.common import LOWER, U64, chunks, cut, mix, range_hashes, utf8

#: Bits of each filter: a power of two, about BITS_A_LINE for each line of LINE_CHARS characters, within these bounds
#: (512 KB to 32 MB). A fuller filter suspects more lines, which are then confirmed; the result is the same.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28
BITS_A_LINE, LINE_CHARS = 8, 64
SEGMENT_BYTES = 1 << 16
SALTS = 16
#: Repeated keys (16 bytes and a doc_id each) that may be broadcast, so that texts need no shuffle; more are joined.
BROADCAST_KEYS = 200_000
#: Bytes of the texts whose lines are dropped at a time.
DROP_BYTES = 2_000_000
STRIP = np.zeros(256, dtype=bool)
STRIP[[9, 10, 11, 12, 13, 32]] = True
STRIP_BYTES = bytes(np.flatnonzero(STRIP).tolist())


def key_of(line: bytes) -> bytes:
    return line.strip(STRIP_BYTES).lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(data: np.ndarray, at: np.ndarray, min_chars: int):
    """(row, start, end, hash) of each different key of min_chars code points or more, once for each text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    low = LOWER[data]
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], breaks + 1]))
    row = np.searchsorted(at, start, "right") - 1  # an empty text's line goes with the next row and is too short anyway
    row = np.minimum(row, len(at) - 2)
    end = np.append(start[1:] - 1, at[-1])
    # a text's last line ends where the next text begins, not one character before
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, at[row + 1], end)
    end = np.maximum(start, end)
    solid = np.flatnonzero(~STRIP[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    some = j >= i
    row, i, j = row[some], i[some], j[some]
    start, end = solid[i], solid[j] + 1
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    long = points[end] - points[start] >= min_chars
    row, start, end = row[long], start[long], end[long]
    h = range_hashes(low, start, end)
    order = np.lexsort((h, row))
    row, start, end, h = row[order], start[order], end[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], start[new], end[new], h[new]


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([h % U64(bits), mix(h ^ U64(0x5851F42D4C957F2D)) % U64(bits)]).astype(np.int64)


def filter_builder(bits: int, min_chars: int):
    """One pair of filters for each task, sent on by non-empty segments, compressed."""

    def run(batches):
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for first, last in chunks(at):
                h = line_keys(data[at[first] : at[last]], at[first : last + 1] - at[first], min_chars)[3]
                h, n = np.unique(h, return_counts=True)
                s = slots(h, bits)
                place, bit = s >> 3, (128 >> (s & 7)).astype(np.uint8)
                again = (n > 1) | ((once[place] & bit) != 0).all(0)
                np.bitwise_or.at(twice, place[:, again], bit[:, again])
                np.bitwise_or.at(once, place, bit)
        a, b = (x.reshape(-1, min(SEGMENT_BYTES, bits // 8)) for x in (once, twice))
        full = np.flatnonzero(a.any(1))
        for part in np.array_split(full, max(1, len(full) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([zlib.compress(a[i].tobytes(), 1) for i in part], pa.binary()), pa.array([zlib.compress(b[i].tobytes(), 1) for i in part], pa.binary())], names=["segment", "once", "twice"])

    return run


def filter_merger(batches):
    """Adds filters up by segment: what two tasks have both seen once counts as seen twice. Holds one pair at most."""
    once, twice = {}, {}
    for batch in batches:
        for i, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if i in once:
                a, b = once[i] | a, twice[i] | b | (once[i] & a)
            once[i], twice[i] = a, b
    for i, b in twice.items():
        if b.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], names=["segment", "twice"])


def suspects_of(data: np.ndarray, at: np.ndarray, twice: np.ndarray, bits: int, min_chars: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows and key digests of the lines, once for each text, that the filter has seen twice."""
    row, start, end, h = line_keys(data, at, min_chars)
    seen = lambda s: ((twice[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).astype(bool)
    s = slots(h, bits)
    hit = np.flatnonzero(seen(s[0]) & seen(s[1]))
    raw = LOWER[data].tobytes() if len(hit) else b""
    return row[hit], [digest(raw[start[i] : end[i]]) for i in hit]


def suspect_finder(shared, bits: int, min_chars: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for first, last in chunks(at):
                rows, keys = suspects_of(data[at[first] : at[last]], at[first : last + 1] - at[first], shared.value, bits, min_chars)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows + first, pa.int64())).cast(pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return run


def without_lines(text: str | None, drop) -> tuple[str | None, int, int]:
    """The text without the lines whose keys' digests are in ``drop``, its lines before, and how many went."""
    if not drop:
        return text, (text or "").count("\n") + 1, 0
    lines = text.encode().split(b"\n")
    stay = [x for x in lines if digest(key_of(x)) not in drop]
    return b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)


def line_dropper(schema: pa.Schema, columns: list[str], drops_of):
    """Rows in runs of about DROP_BYTES of text; ``drops_of(batch)`` gives each row's dropped digests, or None."""

    def run(batches):
        for batch in batches:
            at = utf8(batch.column("text"))[1]
            for first, last in chunks(at, DROP_BYTES):
                part = batch.slice(first, last - first)
                done = [without_lines(text.as_py(), drop) for text, drop in zip(part.column("text"), drops_of(part))]
                new = {c: pa.array([x[i] for x in done], schema.field(c).type) for i, c in enumerate(("text", "n_lines", "n_dropped"))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c).cast(schema.field(c).type) for c in columns], schema=schema)

    return run


def joined_drops(part: pa.RecordBatch):
    return (set(x.as_py() or ()) for x in part.column("__drop"))


def table_drops(shared, keepers, bits: int, min_chars: int):
    """Drops from a broadcast table of repeated keys and their keepers."""

    def run(part: pa.RecordBatch):
        data, at = utf8(part.column("text"))
        ids, out = part.column("__id").to_pylist(), [None] * len(part)
        for first, last in chunks(at):
            rows, keys = suspects_of(data[at[first] : at[last]], at[first : last + 1] - at[first], shared.value, bits, min_chars)
            for row, key in zip((rows + first).tolist(), keys):
                if keepers.value.get(key, ids[row]) != ids[row]:
                    out[row] = out[row] or set()
                    out[row].add(key)
        return out

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with the lines dropped from text, plus n_lines (before) and n_dropped.

    A line's key: blanks and \\t\\n\\v\\f\\r stripped at both ends, A-Z lower-cased. Keys of min_chars code points or
    more found under min_docs different doc_ids or more lose all their lines except under the largest doc_id. Rows
    with the same doc_id are one document; rows with null doc_id are one that comes before all others. Null text stays
    null and counts as one empty line. Filters have ``bits`` bits, by the texts' lengths if None, 32 MB at most, and are
    broadcast once; a hot line costs one suspect row for
    each document, summed up map-side. Up to broadcast_keys confirmed keys go to the tasks with their keepers and texts
    stay where they are; beyond that, dropped keys are joined to the texts by doc_id. Empty tables give no rows; columns n_lines and n_dropped of docs are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "__drop", "__id")])
    texts = docs.select("text")
    if bits is None:
        n_lines = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // LINE_CHARS
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(n_lines * BITS_A_LINE).bit_length()))
    parts = texts.mapInArrow(filter_builder(bits, min_chars), "segment long, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(filter_merger, "segment long, twice binary")
    twice = np.zeros((max(1, bits // 8 // SEGMENT_BYTES), min(SEGMENT_BYTES, bits // 8)), dtype=np.uint8)
    for row in merged.collect():  # at most the filter itself
        twice[row["segment"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    shared = spark.sparkContext.broadcast(twice.ravel())
    first = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(first)).alias("doc_id"), "text")
    suspects = cut(ids.mapInArrow(suspect_finder(shared, bits, min_chars), "doc_id long, key binary"))
    repeated = cut(suspects.groupBy("key", "doc_id").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs).select("key", "keeper"))
    columns = [*docs.columns, "n_lines", "n_dropped"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(first)))
    if repeated.count() <= broadcast_keys:
        table = repeated.toArrow()
        keepers = spark.sparkContext.broadcast(dict(zip(table.column("key").to_pylist(), table.column("keeper").to_pylist())))
        return keyed.mapInArrow(line_dropper(to_arrow_schema(schema), columns, table_drops(shared, keepers, bits, min_chars)), schema)
    # a line of a third of all documents is dealt over SALTS tasks by doc_id; each meets a copy of its key's one row
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted_keepers = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drops = salted.join(salted_keepers, ["key", "salt"]).where("doc_id != keeper").groupBy("doc_id").agg(F.collect_set("key").alias("__drop"))
    joined = keyed.join(drops.withColumnRenamed("doc_id", "__id"), "__id", "left").drop("__id")
    return joined.mapInArrow(line_dropper(to_arrow_schema(schema), columns, joined_drops), schema)


# --------------------------------------------------------------------------- query


def op10_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
