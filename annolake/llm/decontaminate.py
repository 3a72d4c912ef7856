"""Operator 9: benchmark decontamination by winnowing. Each sliding window of k-gram hashes gives its least one as
a fingerprint, so any span of window + k - 1 shared words shares a fingerprint; fingerprints that meet are extended to
whole windows of benchmark words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.llm.common import U64, chunks, grams, mix, utf8, words

#: Benchmark words of one block (about 20 MB). A larger benchmark is scanned for in blocks, of which a task holds one.
BLOCK_WORDS = 1_000_000
ADDED = ("n_words", "n_hit", "items", "runs")


def winnow(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the fingerprints of a row of word hashes (leftmost least k-gram of each window)."""
    g = grams(hashes, k)
    if len(g) < window:
        return np.zeros(0, np.int64), g[:0]
    at = np.lib.stride_tricks.sliding_window_view(g, window).argmin(1) + np.arange(len(g) - window + 1)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, g[at]


def window_hash(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(start), dtype=U64)
    for j in range(n):
        out = out * U64(0xA0761D6478BD642F) + hashes[start + j]
    return mix(out + U64(n))


class Block:
    """Part of a benchmark: sorted fingerprints, and for each window length sorted window hashes with their items."""

    def __init__(self, items: list[str], hashes: np.ndarray, begin: np.ndarray, n: int, k: int):
        self.items, self.n, self.k = items, n, k
        lengths = np.diff(begin)
        marks, found = [], {}
        for i, size in enumerate(lengths):
            if size:
                own, m = hashes[begin[i] : begin[i + 1]], min(n, int(size))
                if m == n:
                    marks.append(winnow(own, k, n - k + 1)[1])
                h = window_hash(own, np.arange(size - m + 1), m)
                found.setdefault(m, []).append((h, np.full(len(h), i)))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, U64)
        self.windows = {}
        for m, parts in found.items():
            h, i = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((i, h))
            self.windows[m] = (h[order], i[order])

    def hits(self, hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length) of each window found in the texts, and (row, item) of what they are windows of."""
        starts, lengths, rows, items = [], [], [], []
        for m, (known, of) in self.windows.items():
            if len(hashes) < m:
                continue
            if m == self.n:
                at, value = winnow(hashes, self.k, m - self.k + 1)
                at = at[known_in(self.marks, value)]
                c = np.unique((at[:, None] - np.arange(m - self.k + 1)).ravel())  # windows that hold the fingerprint
                c = c[(c >= 0) & (c <= len(hashes) - m)]
            else:  # an item shorter than a window: too short for the guarantee, so each place is tried
                c = np.arange(len(hashes) - m + 1)
            row = np.searchsorted(begin, c, "right") - 1
            inside = c + m <= begin[row + 1]
            c, row = c[inside], row[inside]
            h = window_hash(hashes, c, m)
            lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            ok = hi > lo
            c, row, lo, hi = c[ok], row[ok], lo[ok], hi[ok]
            starts.append(c)
            lengths.append(np.full(len(c), m))
            # one range of items for each different (row, window): a passage said again in a text is expanded once
            _, first = np.unique(np.stack([row, lo]), axis=1, return_index=True)
            row, lo, n_items = row[first], lo[first], (hi - lo)[first]
            rows.append(np.repeat(row, n_items))
            items.append(of[np.repeat(lo - np.r_[0, np.cumsum(n_items)[:-1]], n_items) + np.arange(n_items.sum())] if len(lo) else of[:0])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(starts), cat(lengths), cat(rows), cat(items)


def known_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def blocks(bench: DataFrame, n: int, k: int, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """Reads (item_id, text) row by row; the driver holds one block's text at a time. An item is never split."""
    ids, texts, size = [], [], 0
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))

    def made():
        data, at = utf8(pa.array(texts, pa.string()))
        return Block(ids, *words(data, at), n, k)

    for row in bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")).alias("text")).select("*", n_words).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += row[2] + 1
        if size >= most:
            yield made()
            ids, texts, size = [], [], 0
    if ids:
        yield made()


def scanner(found: list, keep: list[str], schema: pa.Schema):
    """Adds n_words, n_hit, items and runs by one narrow pass over whole texts. Blocks are visited in turn for each batch
    of rows; only the present one is in memory, read again from the executor's copy of its broadcast."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            parts = [(first, *words(data[at[first] : at[last]], at[first : last + 1] - at[first])) for first, last in chunks(at)]
            hits = [([], []) for _ in parts]  # (start, end) of windows; (row, item)
            for block in found:
                b = block.value
                for (_, hashes, begin), (places, named) in zip(parts, hits):
                    s, m, row, item = b.hits(hashes, begin)
                    places.append((s, s + m))
                    named += [(r, b.items[i]) for r, i in set(zip(row.tolist(), item.tolist()))]
                if len(found) > 1:
                    del b, block._value
            n_words, n_hit, items, runs = [], [], [], []
            for (_, hashes, begin), (places, named) in zip(parts, hits):
                cover = np.zeros(len(hashes) + 1, np.int64)
                for s, e in places:
                    np.add.at(cover, s, 1)
                    np.add.at(cover, e, -1)
                hit = np.cumsum(cover[:-1]) > 0
                total = np.r_[0, np.cumsum(hit)]
                counts = total[begin[1:]] - total[begin[:-1]]
                n_rows = len(begin) - 1
                own_runs, got = [[] for _ in range(n_rows)], [set() for _ in range(n_rows)]
                for r in np.flatnonzero(counts):
                    edge = np.flatnonzero(np.diff(np.r_[False, hit[begin[r] : begin[r + 1]], False].astype(np.int8)))
                    own_runs[r] = edge.tolist()
                for r, item in named:
                    got[r].add(item)
                n_words.append(np.diff(begin))
                n_hit.append(counts)
                items += [sorted(x) for x in got]
                runs += own_runs
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            new = [pa.array(cat(n_words), pa.int64()), pa.array(cat(n_hit), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in keep), *new], schema=schema)

    return run


def find_contamination(docs: DataFrame, bench: DataFrame, n: int = 10, k: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus n_words, n_hit, items (found item_ids, sorted as strings) and
    runs (start, end of each run of hit words, flat).

    Words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII. A window is n consecutive words of an
    item, or all of a shorter one; a document word inside any occurrence of a window is hit. Documents are never
    shuffled or gathered: one narrow pass visits the benchmark's blocks in turn, so hot passages cost no more than
    others, and a task's memory doesn't grow with the benchmark. Null
    and empty texts and items have no words; repeated items count once by id; documents' own columns of the added
    names are replaced; empty tables give no rows, or rows without hits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    keep = docs.columns if keep is None else [c for c in keep if c in docs.columns]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.LongType()))]
    found = [spark.sparkContext.broadcast(b) for b in blocks(bench, n, k)]
    schema = T.StructType([docs.schema[c] for c in keep] + added)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scanner(found, list(keep), to_arrow_schema(schema)), schema)


# --------------------------------------------------------------------------- query


def op9_decontaminate(spark, sf_dir):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM il)),
ms AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, dg.m, i FROM dg JOIN win ON dg.m = win.m AND dg.x = win.x),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
