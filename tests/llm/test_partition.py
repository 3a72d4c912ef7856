"""Centroids, shards and vector codes against brute force, with their edge cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import centroids, sharding, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, x string, code string"


def awkward_vectors(spark, size, n=60, seed=3):
    """Nulls in every column, equal vectors, repeated rows and ids, far components, other lengths, clashing names."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=size).tolist(), i % 3, 1, "x", "c") for i in range(n)]
    same = rng.normal(size=size).tolist()
    rows += [(100 + i, same, None, None, None, None) for i in range(40)] + [(7, same, 1, 1, "x", "c")] * 3
    rows += [(None, rng.normal(size=size).tolist(), 2, 1, "x", "c"), (300, None, 1, 1, "x", "c"), (301, [], 1, 1, "x", "c"), (302, [None] * size, 1, 1, "x", "c"), (303, [math.inf] * size, 1, 1, "x", "c"), (304, [math.nan] + [0.0] * (size - 1), 1, 1, "x", "c"), (305, [1.0] * (size + 1), 1, 1, "x", "c"), (306, [1e30] * size, 5, 1, "x", "c"), (307, [0.0] * size, 5, 1, "x", "c")]
    return spark.createDataFrame(rows, VECTORS), rows


def good(v, size):
    return v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)


def whole(v, scale):
    return np.clip(np.floor(scale * np.array(v, float)), -centroids.CLAMP, centroids.CLAMP).astype(np.int64)


# --------------------------------------------------------------------------- 11


@pytest.mark.parametrize("seed", range(6))
def test_dual_tree_finds_nearest_centroids(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        n, d, k, s = int(rng.integers(1, 300)), int(rng.integers(1, 6)), int(rng.integers(1, 30)), int(rng.choice([2, 10, 1000, 1 << 27]))
        x = rng.integers(-s, s + 1, (n, d))
        x[: n // 3] = x[0] + rng.integers(0, 2, (n // 3, d))  # far from the origin, and close together
        c = x[rng.integers(0, n, k)] if seed % 2 else rng.integers(-s, s + 1, (k, d))
        order, tree = centroids.cover_tree(x, int(rng.integers(1, 40)))
        assert sorted(order) == list(range(n)) and (x[order] == tree.x).all()
        names, over = centroids.cover_tree(c, k)
        got = np.full(n, -1)
        for lo, end, name in zip(*centroids.dual_tree(tree, over, names)):
            assert (got[lo:end] == -1).all()
            got[lo:end] = name
        assert (got == ((tree.x[:, None] - c) ** 2).sum(2).argmin(1)).all()


def test_cover_tree_bounds():
    x = np.random.default_rng(1).integers(-50, 50, (500, 3))
    _, t = centroids.cover_tree(x, 100)
    gap = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
    for c in range(len(t.lo)):
        below = t.x[t.lo[c] : t.lo[c] + t.size[c]]
        assert gap(below, t.x[t.lo[c]]).max() <= t.reach[c] and gap(below[: t.held[c]], below[0]).max() <= t.near[c]
        assert c == 0 or t.lo[t.parent[c]] <= t.lo[c] < t.lo[t.parent[c]] + t.size[t.parent[c]]
    nodes = t.x[t.lo]
    between = gap(nodes[:, None], nodes)
    # a point that was r from all before it is within 2 ** (floor(log2 r) + 1) of its parent
    for c in range(1, len(nodes)):
        assert between[c, t.parent[c]] <= 2 ** (math.floor(math.log2(between[c, :c].min())) + 1)


def test_dual_tree_pruning_settles_runs():
    rng = np.random.default_rng(2)
    x = (rng.integers(0, 4, (2000, 1)) * 100000 + rng.integers(0, 50, (2000, 4))).astype(np.int64)
    _, t = centroids.cover_tree(x, 256)
    c = np.arange(4)[:, None] * 100000 + np.zeros((1, 4), np.int64)
    names, over = centroids.cover_tree(c, 4)
    assert len(centroids.dual_tree(t, over, names)[0]) < 100  # far groups go whole, not point by point


def lloyd(rows, k, rounds, size, scale):
    import hashlib

    kept = [(i, whole(v, scale)) for i, v, *_ in rows if good(v, size)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    c = np.array([v for _, v in sorted(kept, key=key)[:k]])
    x = np.array([v for _, v in kept])
    near = lambda: ((x[:, None] - c) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        a = near()
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    a = near()
    return sorted(((i if i is not None else -1), int(j), int(((v - c[j]) ** 2).sum())) for (i, v), j in zip(kept, a)), c


@pytest.mark.parametrize("k,block", [(8, 16), (3, 4096), (500, 50)])
def test_lloyd_equals_brute_force(spark, k, block):
    df, rows = awkward_vectors(spark, 6)
    got, c = centroids.dual_tree_lloyd(df, k=k, rounds=10, size=6, block=block, net=8)
    want, want_c = lloyd(rows, k, 10, 6, 1024)
    assert (c == want_c).all()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got.collect()) == want


def test_lloyd_without_kept_vectors(spark):
    df, _ = awkward_vectors(spark, 6)
    got, c = centroids.dual_tree_lloyd(df, size=9)
    assert got.collect() == [] and len(c) == 0
    with pytest.raises(ValueError):
        centroids.dual_tree_lloyd(df, k=10**6)


# --------------------------------------------------------------------------- 12


def law(good, bad, n):
    log = lambda a, k: math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1)
    return {k: math.exp(log(good, k) + log(bad, n - k) - log(good + bad, n)) for k in range(max(0, n - bad), min(good, n) + 1)}


@pytest.mark.parametrize("good,bad,n", [(5, 7, 6), (40, 1000, 500), (500, 300, 700), (100, 100, 199), (2000, 3000, 1000)])
def test_draws_follow_the_hypergeometric_law(spark, good, bad, n):
    lit = lambda v: F.lit(v).cast("long")
    draws = spark.range(8000).select(sharding.hypergeometric(lit(good), lit(bad), lit(n), [F.lit(5), F.col("id")]).alias("k")).groupBy("k").count().collect()
    found, want = {r["k"]: r["count"] for r in draws}, law(good, bad, n)
    assert set(found) <= set(want)
    cells = [k for k in want if want[k] * 8000 >= 5]
    chi = sum((found.get(k, 0) - 8000 * want[k]) ** 2 / (8000 * want[k]) for k in cells)
    assert abs(chi - len(cells) + 1) < 5 * math.sqrt(2 * len(cells))


def test_draws_at_the_ends(spark):
    df = spark.createDataFrame([(0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10), (1, 0, 1), (10**11, 10**11, 10**6)], "g long, b long, n long")
    got = [r.k for r in df.select(sharding.hypergeometric(F.col("g"), F.col("b"), F.col("n"), [F.col("g")]).alias("k")).collect()]
    assert got[:5] == [0, 3, 0, 5, 1] and abs(got[5] - 500000) < 5000


@pytest.mark.parametrize("sizes", [[7], [0, 5, 0, 1000, 3], [100] * 13, [10**7, 1, 10**6]])
def test_matrix_has_both_margins(spark, sizes):
    counts = spark.createDataFrame([(p, n) for p, n in enumerate(sizes) if n], "p long, n long")
    caps = sharding.shard_sizes(sum(sizes), 16)
    assert max(caps) - min(caps) <= 1
    rows = {r["p"]: r["counts"] for r in sharding.communication_matrix(counts, caps, 1).collect()}
    assert {p: sum(c) for p, c in rows.items()} == {p: n for p, n in enumerate(sizes) if n}
    assert [sum(c) for c in zip(*rows.values())] == caps and min(min(c) for c in rows.values()) >= 0


def test_shards_hold_each_row_once(spark):
    rows = [(i % 700 if i % 50 else None, None if i % 9 == 0 else "" if i % 9 == 1 else "same" if i % 9 < 5 else "long " * (i % 7) * 5000, i, "s") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, source string").repartition(7)
    got = sharding.shard_documents(docs, shards=11).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((a, b) for a, b, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(11)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {len(s) for s in by.values()} <= {136, 137}


def test_joined_matrix_gives_the_same_shards(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(5, "doc_id")
    rows = lambda: sorted(tuple(r) for r in sharding.shard_documents(docs, shards=4).collect())
    first = rows()
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 0)
    assert rows() == first


def test_shuffle_is_uniform(spark):
    """Neighbours in the input, and copies of a text, fall to shards and places independently."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("text")).repartition(3, "doc_id")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs, shards=8).collect()}
    pairs = collections.Counter((got[i][0], got[i + 1][0]) for i in range(0, 8000, 2))
    assert abs(sum((pairs[a, b] - 62.5) ** 2 / 62.5 for a in range(8) for b in range(8)) - 63) < 5 * math.sqrt(126)
    low = sum(1 for i in range(0, 8000, 2) if got[i][1] < 500)
    assert abs(low - 2000) < 200


def test_few_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=5)
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(0, 0), (1, 0)]
    empty = sharding.shard_documents(docs.limit(0))
    assert empty.columns == ["doc_id", "text", "shard", "slot"] and empty.count() == 0
    sharding.write_shards(got, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, r.shard) for r in got.collect())


def test_long_text_and_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "ü" * 300000, "x"), (None, None, "x"), (3, "", None)], "doc_id long, text string, law string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.size, r.law, r.grown_shard) for r in sharding.op12_sharding(spark, str(tmp_path)).collect())
    assert got == [(0, 1, "rows", None), (1, 600001, "rows", None), (3, 1, "rows", None)]


def test_native_plan(spark):
    plan = sharding.op12_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --------------------------------------------------------------------------- 13


@pytest.mark.parametrize("seed", range(5))
def test_elkan_rounds_equal_full_rounds(seed):
    rng = np.random.default_rng(seed)
    x, s = rng.integers(-30, 30, (400, 2)), 1 << rng.integers(0, 3)
    x = x // s  # many ties
    books = x[:12].copy()
    entry, upper, lower = vector_codes.first_round(x, books)
    counted = 0
    for _ in range(8):
        assert (entry == ((x[:, None] - books) ** 2).sum(2).argmin(1)).all()
        new = np.array([x[entry == e].sum(0) // (entry == e).sum() if (entry == e).any() else books[e] for e in range(len(books))])
        entry, upper, lower, n = vector_codes.elkan_round(x, new, entry, upper, lower, vector_codes.movement(books, new))
        books, counted = new, counted + n
        d = np.sqrt(((x[:, None] - books) ** 2).sum(2))
        assert (upper * vector_codes.SLACK >= d[np.arange(len(x)), entry]).all() and (lower <= d * vector_codes.SLACK).all()
    assert counted < 0.7 * 8 * x.shape[0] * len(books)  # most distances are ruled out


def product_codes(rows, parts, entries, rounds, scale):
    kept = [(i, whole(v, scale)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    size = len(order[0][1])
    fit = [r for r in order if len(r[1]) == size]
    x = np.array([v for _, v in fit]).reshape(len(fit), parts, -1)
    code, error, books = np.zeros((len(fit), parts), int), np.zeros(len(fit), int), []
    for p in range(parts):
        b = x[:entries, p].copy()
        near = lambda: ((x[:, p][:, None] - b) ** 2).sum(2).argmin(1)
        for _ in range(rounds):
            a = near()
            b = np.array([x[a == j, p].sum(0) // (a == j).sum() if (a == j).any() else b[j] for j in range(len(b))])
        code[:, p] = near()
        error += ((x[:, p] - b[code[:, p]]) ** 2).sum(1)
        books.append(b)
    return sorted((i if i is not None else -1, "".join(f"{e:02x}" for e in c), int(e)) for (i, _), c, e in zip(fit, code, error)), np.array(books)


@pytest.mark.parametrize("entries,block", [(16, 2048), (5, 7), (400, 50)])
def test_codes_equal_brute_force(spark, entries, block):
    df, rows = awkward_vectors(spark, 8)
    got, books = vector_codes.compress(df, parts=4, entries=entries, rounds=6, block=block)
    rows_got = got.collect()
    want, want_books = product_codes(rows, 4, entries, 6, 4096)
    width = max(2, -(-(want_books.shape[1] - 1).bit_length() // 4))
    assert (books == want_books).all() and width == 2
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error) for r in rows_got if r.code) == want
    assert sorted(r.vec_id for r in rows_got if r.code is None) == [301, 305]


def test_label_errors_null_labels_together(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 3), (2, None, 4), (3, None, 5), (4, "a", None)], "vec_id long, label string, error long")
    for bound in (vector_codes.BROADCAST_LABELS, 0):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", bound)
        assert sorted((r.vec_id, r.label_error) for r in vector_codes.label_errors(df).collect()) == [(1, 3), (2, 9), (3, 9), (4, 3)]


def test_codes_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0], None)]
    got, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2)
    assert [(r.vec_id, r.code, r.error) for r in got.collect()] == [(1, None, None)] and books.size == 0
    got, _ = vector_codes.compress(spark.createDataFrame([(1, [], None)], "vec_id long, embedding array<float>, label int"), parts=2)
    assert [(r.vec_id, r.code, r.error) for r in got.collect()] == [(1, "0000", 0)]
