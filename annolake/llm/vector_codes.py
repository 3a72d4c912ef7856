"""Operator 13: vector code compression. Vectors are cut into parts, each with a codebook found by Elkan's Lloyd: the
upper bound of each part and one lower bound for each entry are kept between rounds, entries are ruled out by the triangle
inequality, and ties are settled in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.centroids import CLAMP, MOST_CELLS, finite, lists
from annolake.llm.common import Stored, cut

#: Vectors of one block, the unit of work.
BLOCK = 2048
#: Labels whose sums may be broadcast; those of more are joined.
BROADCAST_LABELS = 200_000
SLACK = 1 + 1e-9
#: Steps of a kept bound: bounds are rounded outwards to 1/STEPS of the block's greatest bound.
STEPS = 65535

STATE = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("x", pa.binary()), ("wide", pa.int32()), ("entry", pa.binary()), ("step", pa.float64()), ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.list_(pa.int64()))])
STATE_SQL = "ids array<long>, labels array<string>, x binary, wide int, entry binary, step double, upper binary, lower binary, sums array<long>"


# --------------------------------------------------------------------------- one part of a block


def exact(x: np.ndarray, entries: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole squared distances of rows i of x from entries c."""
    d = x[i] - entries[c]
    return np.einsum("ij,ij->i", d, d)


def first_round(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of each row by all distances; bounds are the distances themselves."""
    d = np.stack([((x - e) ** 2).sum(1) for e in entries], 1)
    best = d.argmin(1)
    root = np.sqrt(d.astype(np.float64))
    return best, root[np.arange(len(x)), best], root


def elkan_round(x: np.ndarray, entries: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, distances counted) after entries have moved by ``moved``.

    ``upper`` is at least the distance of a row from its own entry, ``lower`` at most that from each entry, both before
    the move. An entry is ruled out only if it is strictly farther than the row's own: by its lower bound, or by half of
    its distance from the own entry. What is left is compared by whole squared distances, the smaller index of equals.
    """
    rows = np.arange(len(x))
    upper, lower = upper + moved[entry], np.maximum(lower - moved, 0)
    half = np.sqrt(((entries[:, None] - entries) ** 2).sum(2).astype(np.float64)) / 2 / SLACK
    np.fill_diagonal(half, np.inf)
    nearest = half.min(1)
    open_rows = rows[upper * SLACK >= nearest[entry]]

    def candidates(i):
        u = (upper[i] * SLACK)[:, None]
        out = (lower[i] <= u) & (half[entry[i]] <= u)
        out[np.arange(len(i)), entry[i]] = False
        return out

    open_rows = open_rows[candidates(open_rows).any(1)]
    own = exact(x, entries, open_rows, entry[open_rows])
    upper[open_rows] = np.sqrt(own.astype(np.float64))
    lower[open_rows, entry[open_rows]] = upper[open_rows]
    at, c = np.nonzero(candidates(open_rows))
    d = exact(x, entries, open_rows[at], c)
    lower[open_rows[at], c] = np.sqrt(d.astype(np.float64))
    # the own entry and the candidates of each row, by distance, then index
    at = np.concatenate([np.arange(len(open_rows)), at])
    c = np.concatenate([entry[open_rows], c])
    d = np.concatenate([own, d])
    order = np.lexsort((c, d, at))
    first = np.ones(len(order), bool)
    first[1:] = at[order][1:] != at[order][:-1]
    order = order[first]
    entry = entry.copy()
    entry[open_rows] = c[order]
    upper[open_rows] = np.sqrt(d[order].astype(np.float64))
    return entry, upper, lower, len(d)


def movement(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far entries have moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(-1).astype(np.float64)) * SLACK


def part_sums(x: np.ndarray, entry: np.ndarray, k: int) -> np.ndarray:
    """Sums of the components of each entry's rows, their number last."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    np.add.at(out[:, :-1], entry, x)
    out[:, -1] = np.bincount(entry, minlength=k)
    return out


# --------------------------------------------------------------------------- tasks


def packed(ids, labels, x, entry, upper, lower, books) -> pa.RecordBatch:
    """A row of the kept state. Bounds are 16 bits each, upper ones rounded up, lower ones down."""
    parts, k, size = books.shape
    step = max(float(upper.max(initial=0)), float(lower.max(initial=0))) * SLACK / (STEPS - 1) or 1.0
    narrow = not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    sums = np.concatenate([part_sums(x[:, p], entry[:, p], k).ravel() for p in range(parts)])
    values = [[ids.to_pylist()], [labels.to_pylist()], [x.astype(np.int16 if narrow else np.int32).tobytes()], [2 if narrow else 4], [entry.astype(np.uint16).tobytes()], [step], [np.ceil(upper / step).astype(np.uint16).tobytes()], [np.floor(lower / step).astype(np.uint16).tobytes()], [sums]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, STATE)], schema=STATE)


def unpacked(batch: pa.RecordBatch, parts: int, k: int, size: int):
    """(ids, labels, x, entry, upper, lower) of each row of the kept state."""
    for i in range(batch.num_rows):
        get = lambda n: batch.column(n)[i].as_py()
        ids = batch.column("ids")[i].values
        n = len(ids)
        x = np.frombuffer(get("x"), np.int16 if get("wide") == 2 else np.int32).astype(np.int64).reshape(n, parts, size)
        bounds = lambda n, shape: np.frombuffer(get(n), np.uint16).reshape(shape) * get("step")
        yield ids, batch.column("labels")[i].values, x, np.frombuffer(get("entry"), np.uint16).astype(np.int64).reshape(n, parts), bounds("upper", (n, parts)), bounds("lower", (n, parts, k))


def begin(books: np.ndarray, block: int):
    """The state after the first assignment, a row for each ``block`` vectors."""
    parts, k, size = books.shape

    def state(t: pa.Table):
        x = t.column("x").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(t.num_rows, parts, size)
        found = [first_round(x[:, p], books[p]) for p in range(parts)]
        entry, upper, lower = (np.stack([f[i] for f in found], 1) for i in range(3))
        return packed(t.column("vec_id").combine_chunks(), t.column("label").combine_chunks(), x, entry, upper, lower, books)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                yield state(pa.Table.from_batches([batch.slice(s, block)]))

    return run


def go_on(books: np.ndarray, moved: np.ndarray):
    """The state after one more assignment."""
    parts, k, size = books.shape

    def run(batches):
        for batch in batches:
            for ids, labels, x, entry, upper, lower in unpacked(batch, parts, k, size):
                found = [elkan_round(x[:, p], books[p], entry[:, p], upper[:, p], lower[:, p], moved[p]) for p in range(parts)]
                yield packed(ids, labels, x, *(np.stack([f[i] for f in found], 1) for i in range(3)), books)

    return run


def sums_of(batches):
    """The sums of a task's blocks, one row."""
    schema, total = pa.schema([("sums", pa.list_(pa.int64()))]), None
    for batch in batches:
        for row in batch.column("sums"):
            s = row.values.to_numpy()
            total = s if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], schema.field(0).type)], schema=schema)


def coded(books: np.ndarray):
    """(vec_id, label, code, error) of each vector of the state."""
    parts, k, size = books.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        for batch in batches:
            for ids, labels, x, entry, _, _ in unpacked(batch, parts, k, size):
                error = sum((exact(x[:, p], books[p], np.arange(len(x)), entry[:, p]) for p in range(parts)), np.zeros(len(x), np.int64))
                width = max(2, -(-(k - 1).bit_length() // 4))
                text = [row.tobytes().hex() for row in entry.astype(np.uint8)] if width == 2 else ["".join(f"{e:0{width}x}" for e in row) for row in entry.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], schema=schema)

    return run


# --------------------------------------------------------------------------- operator


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each kept row of ``vectors`` (vec_id, embedding, label), label as text, and the
    codebooks (part, entry, component).

    Rows whose vector is null or holds null or non-finite components are dropped; each component x becomes
    floor(scale * x), held within +-2**27, and vectors are cut into ``parts`` equal parts. The codebook of a part starts
    as that part of the ``entries`` kept vectors of the least vec_id (of all, if there are fewer); each of ``rounds``
    assigns each part to its nearest entry, ties to the lower index, and replaces entries by floor(sum / count) of their
    parts; unused ones stay. Then parts are assigned again. ``error`` sums the squared distances over the parts.

    The state of a round is a table in the shared folder: vectors in 16 or 32 bits, their entries, and 16 bits for each
    bound; each round reads one and writes the next, without a shuffle, and drops the last. Only sums, parts * entries *
    (size + 1) numbers for each task, are shuffled; the driver sees as many a round, MOST_CELLS at most.

    Vectors of other lengths than the first (by vec_id, nulls last, then by components) can't be coded by its books, nor
    lengths that can't be cut equally: code and error are null. Rows that repeat a vec_id are coded each; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.lit(scale) * x.cast("double")), F.lit(CLAMP)), F.lit(-CLAMP)).cast("int"))
    kept = vectors.where(finite()).select("vec_id", F.col("label").cast("string").alias("label"), whole.alias("x"))
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("x")]
    lead = kept.orderBy(*order).limit(1).collect()
    size = len(lead[0]["x"]) if lead else 0
    fits = (F.size("x") == size) & F.lit(size % parts == 0)
    start = kept.where(fits).orderBy(*order).limit(entries).collect()
    unfit = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not start:
        return unfit, np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["x"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    if books.size > MOST_CELLS or entries > 65536:
        raise ValueError(f"codebooks of {books.size} numbers are more than a round may broadcast")
    state = Stored(kept.where(fits).mapInArrow(begin(books, block), STATE_SQL))
    for _ in range(rounds):
        cells = state.read().select("sums").mapInArrow(sums_of, "sums array<long>").select(F.posexplode("sums").alias("j", "s"))
        total = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), object)
        for r in cells.groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            total[r["j"]] = int(r["s"])
        total = total.reshape(*books.shape[:2], -1)
        used = total[..., -1] > 0
        new = books.copy()
        new[used] = (total[used][:, :-1] // total[used][:, -1:]).astype(np.int64)
        if (new == books).all():
            break  # further rounds change nothing
        after = Stored(state.read().mapInArrow(go_on(new, movement(books, new)), STATE_SQL))
        state.drop()
        state, books = after, new
    out = cut(state.read().mapInArrow(coded(books), "vec_id long, label string, code string, error long"))
    state.drop()
    return out.unionByName(unfit), books


def label_errors(found: DataFrame) -> DataFrame:
    """``found`` with label_error: error summed over equal labels, nulls together. Sums are made map-side and broadcast, or
    joined if there are more than BROADCAST_LABELS."""
    sums = cut(found.groupBy(F.col("label").alias("__l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    few = sums.count() <= BROADCAST_LABELS
    return found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__l"))).drop("__l")


# --------------------------------------------------------------------------- query


def op13_vector_codes(spark, sf_dir):
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_D = "list_sum(list_transform(range(1, 9), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"


def _round_sql(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED (SELECT id, p, x, arg_min(e, (d, e)) AS e FROM (SELECT v.id, v.p, v.x, c.e, CAST({_D} AS BIGINT) AS d FROM v JOIN c{n} c ON c.p = v.p) GROUP BY id, p, x),
m{n} AS (SELECT p, e, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{n}) GROUP BY p, e, j),
u{n} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{n} GROUP BY p, e),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN u{n} u ON u.p = c.p AND u.e = c.e)"""


ORACLE = f"""
WITH w AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT id, p, x[p * 8 + 1 : p * 8 + 8] AS x FROM w, range(8) r(p)),
c0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM w QUALIFY e < 16) s ON s.id = v.id),
{",".join(_round_sql(n) for n in range(6))},
f AS MATERIALIZED (SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.id, v.p, c.e, CAST({_D} AS BIGINT) AS d FROM v JOIN c6 c ON c.p = v.p) GROUP BY id, p),
g AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY id),
b AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM c6))
SELECT w.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM w JOIN g ON g.id = w.id, b
"""
