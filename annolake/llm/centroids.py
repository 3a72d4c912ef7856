"""Operator 11: centroid clustering by dual-tree Lloyd. Cover trees over the vectors are built once and kept; in each round
they meet a tree over the centroids, pairs of nodes are pruned by distance bounds, and what is left at the leaves is
compared exactly, in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import Stored, cut

#: Vectors of one cover tree, the unit of work.
BLOCK = 4096
#: Most nodes of a cover tree over vectors; further vectors lie in its nodes' buckets.
NET = 256
#: Components are held within +-CLAMP, so that squared distances of 64 components fit a long.
CLAMP = 1 << 27
#: Centroids times components that may be broadcast and collected each round.
MOST_CELLS = 4_000_000
#: Bits of the order that puts vectors of like direction into one tree.
ORDER_BITS = 24
PAIRS = 1 << 16
SLACK = 1 + 1e-9

TREE = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.list_(pa.int32()))] + [(n, pa.list_(pa.int32())) for n in ("lo", "held", "size", "parent")] + [("reach", pa.list_(pa.float64())), ("near", pa.list_(pa.float64()))])
TREE_SQL = "ids array<long>, x array<int>, lo array<int>, held array<int>, size array<int>, parent array<int>, reach array<double>, near array<double>"


# --------------------------------------------------------------------------- cover trees


class CoverTree:
    """A cover tree over rows of whole numbers. Node c has its own point at row ``lo[c]``, its bucket in the rows
    ``lo[c] : lo[c] + held[c]`` and all below it in ``lo[c] : lo[c] + size[c]``; ``reach`` and ``near`` bound the
    distance of its point from these. A parent comes before its children."""

    def __init__(self, x, lo, held, size, parent, reach, near):
        self.x, self.lo, self.held, self.size, self.parent, self.reach, self.near = x, lo, held, size, parent, reach, near
        self.kids = np.argsort(parent[1:], kind="stable") + 1
        self.first = np.searchsorted(parent[1:][self.kids - 1], np.arange(len(lo) + 1))


def dense(points: list) -> np.ndarray:
    return np.concatenate(points) if points else np.zeros(0, np.int64)


def cover_tree(x: np.ndarray, net: int) -> tuple[np.ndarray, CoverTree]:
    """The order of the rows of ``x`` in their tree, and the tree.

    Points are chosen farthest first. One that was r from all before it has level floor(log2 r): points of a level and
    above are farther than 2**level from each other, and each lies within 2**(level + 1) of its parent, the nearest
    point of a higher level. The first point has the highest level. Points not chosen, because all they are equal to
    chosen ones or ``net`` points are chosen, lie in the bucket of the nearest chosen one.
    """
    f = x.astype(np.float64)
    norms = np.einsum("ij,ij->i", f, f)
    if 4 * norms.max() < 1 << 52:  # exact in double precision
        away = lambda j: norms - 2 * (f @ f[j]) + norms[j]
    else:
        away = lambda j: ((x - x[j]) ** 2).sum(1).astype(np.float64)
    chosen, own, dist = [0], np.zeros(len(x), np.int64), [away(0)]
    nearest, level = dist[0].copy(), [np.inf]
    while len(chosen) < min(net, len(x)):
        j = int(nearest.argmax())
        if nearest[j] == 0:
            break
        d = away(j)
        level.append(np.floor(0.5 * np.log2(nearest[j])))
        chosen.append(j)
        dist.append(d)
        closer = d < nearest
        own[closer], nearest[closer] = len(chosen) - 1, d[closer]
    m = len(chosen)
    between, level = np.array([d[chosen] for d in dist]), np.array(level)
    parent = np.zeros(m, np.int32)
    for c in range(1, m):
        over = np.flatnonzero(level[:c] > level[c])
        parent[c] = over[between[over, c].argmin()]
    held = np.bincount(own, minlength=m).astype(np.int32)
    size = held.copy()
    for c in range(m - 1, 0, -1):
        size[parent[c]] += size[c]
    lo, free = np.zeros(m, np.int32), np.zeros(m, np.int32)
    free[0] = held[0]
    for c in range(1, m):
        lo[c] = free[parent[c]]
        free[parent[c]] += size[c]
        free[c] = lo[c] + held[c]
    leads = np.ones(len(x), bool)
    leads[chosen] = False  # a node's own point comes first in its bucket
    members = np.lexsort((np.arange(len(x)), leads, own))
    order = np.empty(len(x), np.int64)
    order[np.repeat(lo, held) + np.arange(len(x)) - np.repeat(np.cumsum(held) - held, held)] = members
    x = x[order]
    reach, near = np.zeros(m), np.zeros(m)
    for c in range(m):
        d = np.sqrt(((x[lo[c] : lo[c] + size[c]] - x[lo[c]]) ** 2).sum(1).astype(np.float64))
        reach[c], near[c] = d.max() * SLACK, d[: held[c]].max() * SLACK
    return order, CoverTree(x, lo, held, size, parent, reach, near)


def squared(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows i of a and j of b."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), PAIRS):
        d = a[i[s : s + PAIRS]] - b[j[s : s + PAIRS]]
        out[s : s + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def entered(tree: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """``nodes``, or their buckets where there is nothing else below them."""
    return np.where(tree.first[nodes + 1] == tree.first[nodes], len(tree.lo) + nodes, nodes)


def children(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``nodes``, child): nodes below each, and its bucket. Nodes are numbered 0 to m - 1, buckets from m on,
    points from 2m on; a bucket's children are its points."""
    m = len(tree.lo)
    node, bucket = np.flatnonzero(nodes < m), np.flatnonzero(nodes >= m)
    c = nodes[node]
    n = tree.first[c + 1] - tree.first[c]
    below = tree.kids[np.repeat(tree.first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    below = entered(tree, below)
    b = nodes[bucket] - m
    h = tree.held[b]
    points = 2 * m + np.repeat(tree.lo[b], h) + np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h)
    return np.concatenate([np.repeat(node, n), node, np.repeat(bucket, h)]), np.concatenate([below, m + c, points])


def dual_tree(vectors: CoverTree, centroids: CoverTree, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, end row, number of the centroid) of runs of rows that together are all rows of ``vectors``.

    Pairs of a node of vectors and a node of centroids go down both trees at once. A node of vectors is no farther from
    its centroid than from the point of any node that it is paired with, plus its own radius; pairs that are farther
    apart by all their radii can't hold a nearest centroid, nor an equally near one, and go. A node whose only pair is
    one centroid is settled whole. ``names``: the centroids' numbers by row of their tree, of equal ones the least
    first in its bucket.
    """
    m, k = len(vectors.lo), len(centroids.lo)
    radius = np.concatenate([vectors.reach, vectors.near, np.zeros(len(vectors.x))])
    lo = np.concatenate([vectors.lo, vectors.lo, np.arange(len(vectors.x))]).astype(np.int64)
    end = lo + np.concatenate([vectors.size, vectors.held, np.ones(len(vectors.x), np.int64)])
    reach = np.concatenate([centroids.reach, np.zeros(k)])  # a bucket of centroids holds equal ones only
    point = np.concatenate([centroids.lo, centroids.lo]).astype(np.int64)
    q, r, done = entered(vectors, np.zeros(1, np.int64)), entered(centroids, np.zeros(1, np.int64)), []
    while len(q):
        order = np.argsort(q, kind="stable")
        q, r = q[order], r[order]
        d = np.sqrt(squared(vectors.x, lo[q], centroids.x, point[r]).astype(np.float64))
        nodes, begin, which = np.unique(q, return_index=True, return_inverse=True)
        bound = np.minimum.reduceat(d, begin) + radius[nodes]
        keep = d - radius[q] - reach[r] <= bound[which] * SLACK + 1e-6
        q, r, which = q[keep], r[keep], which[keep]
        n = np.bincount(which, minlength=len(nodes))
        single = (n[which] == 1) & (r >= k)
        done.append((lo[q[single]], end[q[single]], names[point[r[single]]]))
        q, r, which = q[~single], r[~single], which[~single]
        if not len(q):
            break
        wide = (r < k) & ((reach[r] >= radius[q]) | (radius[q] == 0))
        opens = np.bincount(which, weights=wide, minlength=len(nodes)) > 0
        flat = (radius[nodes] == 0) & ~opens
        # leaf pairs: exact distances, the smaller number of equals
        leaf = flat[which]
        if leaf.any():
            a, b = q[leaf], r[leaf]
            rank = np.lexsort((names[point[b]], squared(vectors.x, lo[a], centroids.x, point[b]), a))
            first = np.ones(len(a), bool)
            first[1:] = a[rank][1:] != a[rank][:-1]
            a, b = a[rank][first], b[rank][first]
            done.append((lo[a], end[a], names[point[b]]))
        of_r = opens[which] & wide
        of_q = ~opens[which] & ~leaf
        stay = opens[which] & ~wide
        i, new_r = children(centroids, r[of_r])
        j, new_q = children(vectors, q[of_q])
        q, r = np.concatenate([q[stay], q[of_r][i], new_q]), np.concatenate([r[stay], new_r, r[of_q][j]])
    return tuple(dense([x[i] for x in done]) for i in range(3))


# --------------------------------------------------------------------------- tasks


def whole_numbers(scale: int):
    """(vec_id, x, key): components as floor(scale * x), and signs of fixed projections as one number."""
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("key", pa.int64())])
    planes = {}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("embedding")
                v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                size = v.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng(size).standard_normal((size, ORDER_BITS))
                x = np.clip(np.floor(scale * v), -CLAMP, CLAMP).astype(np.int32)
                key = (x @ planes[size] > 0) @ (1 << np.arange(ORDER_BITS - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), lists(x), pa.array(key, pa.int64())], schema=schema)

    return run


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def plant(block: int, net: int):
    """A row for each ``block`` vectors: their cover tree."""

    def tree(ids, x):
        order, t = cover_tree(x.astype(np.int64), net)
        row = {"ids": [ids.take(pa.array(order))], "x": [t.x.ravel()], "lo": [t.lo], "held": [t.held], "size": [t.size], "parent": [t.parent], "reach": [t.reach], "near": [t.near]}
        return pa.RecordBatch.from_arrays([pa.array([v[0].to_pylist() if isinstance(v[0], pa.Array) else v[0]], TREE.field(n).type) for n, v in row.items()], schema=TREE)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == block:
                    yield tree(*joined(held))
                    held, n = [], 0
        if n:
            yield tree(*joined(held))

    def joined(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        x = t.column("x").combine_chunks()
        return t.column("vec_id").combine_chunks(), x.flatten().to_numpy().reshape(len(x), -1)

    return run


def trees(batches):
    """(ids, tree) of each row of a table of trees."""
    for batch in batches:
        column = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            get = lambda n: column[n][i].values.to_numpy(zero_copy_only=False)
            ids = column["ids"][i].values if "ids" in column else None
            lo = get("lo")
            rows = int(get("size")[0])
            yield ids, CoverTree(get("x").astype(np.int64).reshape(rows, -1), lo, get("held"), get("size"), get("parent"), get("reach"), get("near"))


def round_sums(centroids: np.ndarray):
    """For each centroid: the sums of its vectors' components over a task, their number last."""
    schema = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        order, tree = cover_tree(centroids, len(centroids))
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, t in trees(batches):
            lo, end, c = dual_tree(t, tree, order)
            upto = np.zeros((len(t.x) + 1, t.x.shape[1]), np.int64)
            np.cumsum(t.x, 0, out=upto[1:])
            np.add.at(total[:, :-1], c, upto[end] - upto[lo])
            np.add.at(total[:, -1], c, end - lo)
        seen = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), lists(total[seen])], schema=schema)

    return run


def assigned(centroids: np.ndarray):
    """(vec_id, cluster, distance) of each vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        order, tree = cover_tree(centroids, len(centroids))
        for ids, t in trees(batches):
            lo, end, c = dual_tree(t, tree, order)
            cluster = np.zeros(len(t.x), np.int64)
            cluster[np.repeat(lo, end - lo) + np.arange(len(t.x)) - np.repeat(np.cumsum(end - lo) - (end - lo), end - lo)] = np.repeat(c, end - lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(squared(t.x, np.arange(len(t.x)), centroids, cluster))], schema=schema)

    return run


# --------------------------------------------------------------------------- operator


def finite(size: int | None = None):
    """Vectors without null or non-finite components, of ``size`` components."""
    v = F.col("embedding")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return good if size is None else good & (F.size(v) == size)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the least hash of ``salt`` and vec_id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.col("key").isNull(), "key", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def dual_tree_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:", block: int = BLOCK, net: int = NET) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector of ``vectors`` (vec_id, embedding), and the final centroids.

    Kept are vectors of exactly ``size`` components, none of them null or non-finite; each component x becomes
    floor(scale * x), held within +-2**27. Centroids start as the ``k`` vectors of the least sha256 of ``salt`` and
    vec_id (all of them if there are fewer); each of ``rounds`` assigns each vector to its nearest centroid, ties to the
    smaller number, and replaces centroids by floor(sum / count) of their vectors; ones without vectors stay. Then
    vectors are assigned once more.

    Vectors are put in order by signs of fixed projections, so that those of one tree are near each other, over ranges
    that split equal vectors too; trees of ``block`` vectors are planted once, and rounds read them. A task gives sums of its
    vectors, k rows; the driver sees k * size sums a round, MOST_CELLS of them at most. Rows that repeat a vec_id are
    vectors of their own; null vec_ids start no centroid while others are there; a table without kept vectors gives no rows. Other
    columns are ignored.
    """
    if k * (size + 1) > MOST_CELLS:
        raise ValueError(f"{k} centroids of {size} components are more than a round may broadcast")
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "embedding").where(finite(size))
    whole = kept.mapInArrow(whole_numbers(scale), "vec_id long, x array<int>, key long")
    start = first_centroids(whole, k, salt)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), start
    tasks = max(spark.sparkContext.defaultParallelism, -(-kept.count() // (16 * block)))
    dealt = whole.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(tasks, "key", "salt").sortWithinPartitions("key", "salt")
    planted = Stored(dealt.select("vec_id", "x").mapInArrow(plant(block, net), TREE_SQL))
    centroids = start
    for _ in range(rounds):
        sums = planted.read().drop("ids").mapInArrow(round_sums(centroids), "cluster int, sums array<long>")
        cells = sums.select("cluster", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        total: dict[int, dict[int, int]] = {}
        for r in cells.collect():
            total.setdefault(r["cluster"], {})[r["j"]] = int(r["s"])
        new = centroids.copy()
        for c, s in total.items():
            new[c] = [s[j] // s[size] for j in range(size)]
        if (new == centroids).all():
            break  # further rounds change nothing
        centroids = new
    out = cut(planted.read().mapInArrow(assigned(centroids), "vec_id long, cluster int, distance long"))
    planted.drop()
    return out, centroids


# --------------------------------------------------------------------------- query


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256."""
    spark = found.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    rows = [(c, min(s, most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    return with_inertia(*dual_tree_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


_D = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"


def _round_sql(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED (SELECT id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, v.x, c.c, CAST({_D} AS BIGINT) AS d FROM v, c{n} c) GROUP BY id, x),
m{n} AS (SELECT c, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{n}) GROUP BY c, j),
u{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN u{n} u ON u.c = c.c)"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(id AS VARCHAR))) - 1 AS c, x FROM v QUALIFY c < 8),
{",".join(_round_sql(n) for n in range(10))},
f AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, c.c, CAST({_D} AS BIGINT) AS d FROM v, c10 c) GROUP BY id)
SELECT id AS vec_id, CAST(f.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(c10.x, lambda y: CAST(y AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM f JOIN c10 ON c10.c = f.c
"""
