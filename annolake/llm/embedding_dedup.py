"""Operator 6: embedding near-dedup by sorted projection passes. Each pass orders the vectors lexicographically by the
concatenated bits of random projections, compares neighbour windows of bounded size, and verified pairs are united
across passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.common import connected_components, cut

#: Passes of one round.
PASSES = 16
#: Rounds go on until a link at the threshold is missed with so small an estimated probability.
MISS = 1e-4
#: Vectors of a tile where all that is left is compared.
TILE = 2048
BITS = 48
#: Vectors of one window of two slots; each is compared with all others of its windows.
WINDOW = 1024
#: Slots (half windows) of one block, the unit of work: all but one slot in BLOCK are sent once a pass.
BLOCK = 8
#: Order ranges of a pass: the first bits of the key, so that no task sorts a pass by itself.
RANGE_BITS = 10


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, unit rows in double precision) for each length of vector; all components are finite, some not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(at)
    out = []
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        x = values[at[rows][:, None] + np.arange(n)]
        x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def bit_keys(passes: int, bits: int, seed: int):
    """(class key, pass, sort key) rows: bits of the signs of seeded projections, most significant first."""
    planes: dict[int, np.ndarray] = {}
    schema = pa.schema([("cls", pa.int64()), ("pass", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column("cls").to_numpy()
            for own, x in unit_rows(batch.column("embedding")):
                size = x.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, passes * bits))
                signs = (x @ planes[size] > 0).reshape(len(own), passes, bits).astype(np.int64)
                key = (signs << np.arange(bits - 1, -1, -1)).sum(2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[own], passes)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(own))), pa.array(key.ravel())], schema=schema)

    return run


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of n rows over links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(threshold: float):
    """A spanning forest of the verified links of a block's neighbour windows, as (u, v): at most one row for each
    vector. Each slot that the block owns is compared with itself and with the next slot; of each such square of
    cosines only a forest is kept, so that a block of equal directions takes no more memory than any other."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, slot = table.column("cls").to_numpy(), table.column("slot").to_numpy()
        block = table.column("block")[0].as_py()
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, x in unit_rows(table.column("embedding")):
            rows = {s: np.flatnonzero(slot[own] == s) for s in np.unique(slot[own])}
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, left in rows.items():
                if s // BLOCK == block:
                    both = np.concatenate([left, rows.get(s + 1, left[:0])])
                    i, j = np.nonzero(x[left] @ x[both].T >= threshold)
                    label = forest(len(both), i, j)
                    linked = np.flatnonzero(label != np.arange(len(both)))
                    a.append(both[linked])
                    b.append(both[label[linked]])
            label = forest(len(own), np.concatenate(a), np.concatenate(b))
            linked = np.flatnonzero(label != np.arange(len(own)))
            u.append(ids[own[linked]])
            v.append(ids[own[label[linked]]])
        return pa.Table.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], schema=schema)

    return run


def tile_links(threshold: float):
    """A spanning forest of the verified links between two tiles, or within one, as (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, tile = table.column("cls").to_numpy(), table.column("tile").to_numpy()
        first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, x in unit_rows(table.column("embedding")):
            left, right = np.flatnonzero(tile[own] == first), np.flatnonzero(tile[own] == second)
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            label = forest(len(own), left[a], right[b])
            linked = np.flatnonzero(label != np.arange(len(own)))
            u.append(ids[own[linked]])
            v.append(ids[own[label[linked]]])
        return pa.Table.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], schema=schema)

    return run


def tiled(vectors: DataFrame) -> DataFrame:
    """``vectors`` with their tile among ``tiles``, once for each pair (a, b) of tiles, a <= b, that theirs is one of."""
    m = vectors.withColumn("tile", (F.pmod(F.xxhash64("cls"), F.col("tiles"))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("a"), F.greatest("tile", o).alias("b")))
    return m.withColumn("pair", F.explode(pairs)).select("*", "pair.a", "pair.b").drop("pair", "tiles")


def sorted_passes(classes: DataFrame, threshold: float, passes: int, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) links of one round of passes, and (cls, gain): the log of the estimated probability that the round misses
    a link of cls at the threshold.

    A vector is compared with all of its slot (half a window) and of the slots beside it. If it differs from the
    nearest keys beyond these within L bits, whatever has its first L bits is among them, and a vector at the threshold
    has with probability (1 - arccos(threshold) / pi)**L, whatever the others are.
    """
    keys = cut(classes.select("cls", "embedding").mapInArrow(bit_keys(passes, BITS, seed), "cls long, pass int, key long"))
    keys = keys.withColumn("range", F.shiftright("key", BITS - RANGE_BITS))
    sums = keys.groupBy("pass", "range").agg(F.count("*").alias("n"))
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("pass").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("pass", "range").orderBy("key", "cls")) - 1 + F.col("before")
    half = window // 2
    placed = cut(keys.join(starts, ["pass", "range"]).withColumn("slot", F.floor(place / half).cast("long")).select("cls", "pass", "key", "slot"))
    ends = cut(placed.groupBy("pass", "slot").agg(F.min("key").alias("first"), F.max("key").alias("last")))
    under, over = ends.select("pass", (F.col("slot") + 2).alias("slot"), F.col("last").alias("under")), ends.select("pass", (F.col("slot") - 2).alias("slot"), F.col("first").alias("over"))
    shared = lambda c: F.when(F.col(c).isNull(), -1).when(F.col(c) == F.col("key"), BITS).otherwise(BITS - F.length(F.bin(F.col("key").bitwiseXOR(F.col(c)))))
    bits = F.greatest(shared("under"), shared("over")) + 1
    miss = F.when(bits > BITS, 1.0).otherwise(F.greatest(1 - F.pow(F.lit(1 - math.acos(threshold) / math.pi), bits), F.lit(1e-9)))
    gain = cut(placed.join(under, ["pass", "slot"], "left").join(over, ["pass", "slot"], "left").groupBy("cls").agg(F.sum(F.log(miss)).alias("gain")))
    # a block owns BLOCK slots and borrows the slot after them: pairs of slots side by side meet in exactly one block
    block = F.floor(F.col("slot") / BLOCK).cast("long")
    borrowed = F.when((F.col("slot") % BLOCK == 0) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = placed.select("cls", "pass", "slot", F.explode(borrowed).alias("block"))
    links = spread.join(classes.select("cls", "embedding"), "cls").groupBy("pass", "block").applyInArrow(block_links(threshold), "u long, v long")
    return cut(links.distinct()), gain


def found_links(classes: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    """(u, v) links that join all components: rounds of passes over the vectors that could still miss a link, then all
    pairs of these as soon as that is less work than the rounds that are still needed."""
    links, rest, turn = None, classes.select("cls", "embedding").withColumn("log_miss", F.lit(0.0)), 0
    while True:
        new, gain = sorted_passes(rest, threshold, passes, window, seed + 1000 * turn)
        links = new if links is None else links.union(new)
        after = rest.join(gain, "cls").withColumn("log_miss", F.col("log_miss") + F.col("gain"))
        # a pair is missed no more likely than either of its vectors misses it: whoever is sure needn't come again
        rest = cut(after.where(F.col("log_miss") > math.log(MISS)).select("cls", "embedding", "log_miss", "gain"))
        n, worst, mean = rest.agg(F.count("*"), F.max("log_miss"), F.avg("gain")).first()
        rest, turn = rest.drop("gain"), turn + 1
        if not n:
            return links
        if mean > -1e-6 or n / 2 <= (worst - math.log(MISS)) / -mean * passes * 2 * window:
            all_pairs = tiled(rest.select("cls", "embedding", F.lit(-(-n // TILE)).alias("tiles")))
            return links.union(all_pairs.groupBy("a", "b").applyInArrow(tile_links(threshold), "u long, v long"))


def tile_counts(threshold: float):
    """For two tiles of one component: (class, weight of the classes of the other tile that it links with)."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, tile, copies = (table.column(c).to_numpy() for c in ("cls", "tile", "copies"))
        first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        out_ids, out_n = [], []
        for k, x in unit_rows(table.column("embedding")):
            left, right = np.flatnonzero(tile[k] == first), np.flatnonzero(tile[k] == second)
            if not len(left) or not len(right):
                continue
            s = x[left] @ x[right].T >= threshold
            if first == second:
                np.fill_diagonal(s, False)
                out_ids.append(ids[k[left]])
                out_n.append(s @ copies[k[right]])
            else:
                out_ids += [ids[k[left]], ids[k[right]]]
                out_n += [s @ copies[k[right]], s.T @ copies[k[left]]]
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(cat(out_ids)), pa.array(cat(out_n))], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int = PASSES, window: int = WINDOW, seed: int = 6) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class, which is compared once and counts with its copies. A pass orders the classes by its
    key over 2**RANGE_BITS ranges of it, numbers them through with sums of the ranges, and cuts the order into windows
    that overlap by half; a window sends on a spanning forest of its links. After a round of ``passes``, vectors that
    could still miss a link by more than MISS go through further rounds among themselves, or are all compared where that
    is less work, so that neither more rows nor dense groups lose links. Components of the united forests are final; links within one are then counted exactly by tiles of ``window`` vectors, which are counts, not pairs.
    Verified cosines are of unit rows in double precision; a class's copies link with each other.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and stand for themselves,
    as do vectors of different lengths to each other. Rows that repeat a vec_id are vectors of their own for counts;
    the component is the least vec_id; null vec_ids have a null component and are kept. An empty table gives no rows.
    """
    text = F.when(F.col("ok"), F.sha2(F.to_json(F.struct("embedding")), 256))
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").withColumn("ok", F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("same", text)
    ids = rows.select("vec_id", "ok", "same")
    classes = cut(rows.where("ok").groupBy("same").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    links = found_links(classes, threshold, passes, window, seed)
    comps = cut(connected_components(links.distinct()))
    members = comps.join(classes, comps["node"] == classes["cls"]).select("component", "cls", "copies", "embedding")
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / window).cast("int").alias("tiles"))
    # each tile meets each other tile of its component once: (a, b) with a <= b
    m = tiled(members.join(sizes, "component"))
    counted = m.groupBy("component", "a", "b").applyInArrow(tile_counts(threshold), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
    about = classes.select("same", "cls", "copies").join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(counted, "cls", "left")
    out = ids.join(about, "same", "left")
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long")
    component = F.coalesce("component", "cls", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


# --------------------------------------------------------------------------- query


def op6_embedding_dedup(spark, sf_dir):
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u),
reach(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u),
c AS (SELECT u, min(w) AS c FROM reach GROUP BY u)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v JOIN c ON v.vec_id = c.u LEFT JOIN n ON n.u = v.vec_id
"""
