"""Helpers that several corpus operators share: lineage cuts, components, byte-level text arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; local sessions without one get a folder."""
    sc = spark.sparkContext
    set_by_conf = sc.getConf().get("spark.checkpoint.dir", None)
    if set_by_conf:
        return set_by_conf
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="annolake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that lost executors cost no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """A table written, compressed, to the shared folder, for what is read several times; ``drop`` frees its files."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        # createDataFrame([]) would start Python workers on every executor, beside those of mapInArrow
        none = self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        none.write.mode("overwrite").parquet(self.path)


# --------------------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) undirected links of longs -> (node, component): the smallest node reachable. Self links are ignored, and a
    node without others isn't in the result.

    Alternates large-star and small-star steps (grouped minimum, then a join back), each linear in the links; a hub's
    links are split by adaptive skew handling since no step gathers a neighbourhood. Rounds grow with the logarithm of
    the longest chain.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    nodes = cut(e.select(F.col("u").alias("node")).union(e.select("v")).distinct())
    before = None
    while True:
        # large star: every neighbour above u is tied to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its lower neighbours are tied to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


# --------------------------------------------------------------------------- bytes and hashes

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 250_000


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = powers(base, 1 << max(12, int(n - 1).bit_length()))
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: Bytes of words once A-Z are lower-cased: 0-9, a-z, and every byte of a character beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 places where its values begin and end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES):
    """Runs (first, last) of rows whose bytes come to about ``most``; one long row may be a run of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, from one prefix sum."""
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * cached_powers(BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * cached_powers(INVERSE, len(data) + 1)[start] + (end - start).astype(U64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts whose bytes are ``data``, and the n + 1 places among them where texts begin."""
    data = LOWER[data]
    inside = WORD[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return range_hashes(data, start, end), np.searchsorted(start, at)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, those across two texts included; empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out ^ U64(k))


def lengths_to_ids(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)
