"""Operator 3: MinHash near-dedup by ProbMinHash. The elements of a document's weighted shingles arrive as Poisson
processes of rate weight; each register keeps the element that arrives first, a document's loop ending early once no
later arrival can win. Registers agree with the probability Jaccard similarity; bands of them give candidates, which
are verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import U64, Stored, chunks, connected_components, cut, grams, lengths_to_ids, mix, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5  # at 0.8: 1 - (1 - 0.8**5)**24 = 0.99993
#: Bands of the first round. What it links leaves buckets of one component, which later rounds pass over.
FIRST_BANDS = 6
#: Leader rounds before what is still open is compared in blocks.
LEADER_ROUNDS = 2
#: Bytes of shingles of one block of an open bucket; a task holds two blocks.
BLOCK_BYTES = 8_000_000
#: Classes that are compared with as many others at a time, and shingles of these at a time.
TILE, COLUMNS = 256, 8192
#: Ids of candidates that may be broadcast to fetch their texts; more are met in a shuffle.
BROADCAST_IDS = 2_000_000
#: Bits of an arrival's hash that choose the register, and that give the time.
UNIT = 2.0**-53


def shingles(hashes: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle: runs of k words inside a text; all of a text that has fewer but some."""
    n = np.diff(begin)
    g = grams(hashes, k)
    row = lengths_to_ids(np.maximum(n - k + 1, 0))
    offset = lengths_to_ids_offset(np.maximum(n - k + 1, 0))
    full = g[begin[row] + offset] if len(row) else g[:0]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.zeros(len(short), dtype=U64)
        for i, r in enumerate(short):
            own[i] = grams(hashes[begin[r] : begin[r + 1]], int(n[r]))[0]
        row, full = np.concatenate([row, short]), np.concatenate([full, own])
    return row, full


def lengths_to_ids_offset(lengths: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def weighted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, and how often each occurs."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) winning elements. Round i handles the i-th arrival of every element still in the race, for all rows
    at once: an arrival after the latest of its row's registers ends its element's process, so that a row of n elements
    costs about n + m log m arrivals. Rows without elements stay zero."""
    first = np.full(n_rows * m, np.inf)
    winner = np.zeros(n_rows * m, dtype=U64)
    limit = np.full(n_rows, np.inf)
    time, live, i = np.zeros(len(row)), np.arange(len(row)), 0
    while len(live):
        i += 1
        r = mix(element[live] ^ mix(np.full(1, i, dtype=U64) * U64(0x9E3779B97F4A7C15)))
        time[live] += -np.log1p(-((r >> U64(11)).astype(np.float64) * UNIT)) / weight[live]
        register = (mix(r ^ U64(0xD1B54A32D192ED03)) % U64(m)).astype(np.int64)
        slot = row[live] * m + register
        t = time[live]
        better = np.flatnonzero(t < first[slot])
        if len(better):
            order = better[np.lexsort((t[better], slot[better]))]
            s = slot[order]
            lead = order[np.r_[True, s[1:] != s[:-1]]]
            first[slot[lead]] = t[lead]
            winner[slot[lead]] = element[live[lead]]
            changed = np.unique(row[live[lead]])
            limit[changed] = first.reshape(n_rows, m)[changed].max(1)
        live = live[t < limit[row[live]]]
    return winner.reshape(n_rows, m)


def signer(bands: int, rows: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])
    m = bands * rows

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for first, last in chunks(at, 1_000_000):
                hashes, begin = words(data[at[first] : at[last]], at[first : last + 1] - at[first])
                n = last - first
                row, element, weight = weighted(*shingles(hashes, begin, k))
                sig = signatures(row, element, weight, n, m)
                key = np.zeros((n, bands), dtype=U64)
                for j in range(rows):
                    key = mix(key * U64(0xD6E8FEB86659FD93) + sig[:, j::rows])
                key = mix(key ^ (np.arange(bands, dtype=U64) * U64(0xA0761D6478BD642F)))
                some = np.flatnonzero(np.diff(begin) > 0)
                # equal words in equal order: two independent sums over places
                place = U64(2) * lengths_to_ids_offset(np.diff(begin)).astype(U64) + U64(1)
                of = lengths_to_ids(np.diff(begin))
                sums = [np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)]
                np.add.at(sums[0], of, mix(hashes ^ mix(place)))
                np.add.at(sums[1], of, mix(hashes * U64(0x9FB21C651E98DF25) ^ mix(place + U64(77))))
                same = np.stack([sums[0], sums[1], np.diff(begin).astype(U64)], 1)[some]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * bands + 1, bands), pa.int32()), pa.array(key[some].view(np.int64).ravel()))
                ids = batch.column("doc_id").slice(first, n).take(pa.array(some)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in same], pa.binary()), lists], schema=schema)

    return run


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum_j max(a_j / a_i, b_j / b_i); for sets it is their Jaccard similarity.

    With t = a_i / b_i the inner sum is (sum of a_j with a_j / b_j > t) / a_i + (sum of b_j with a_j / b_j <= t) / b_i,
    so that sorted ratios and running sums replace the double loop.
    """
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = wa[ia], wb[ib]
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    ra = ratio[order]
    a_sum, b_sum = np.r_[0, np.cumsum(a[order])], np.r_[0, np.cumsum(b[order])]
    upto = np.searchsorted(ra, ratio, "right")
    more_a = wa.sum() - a_sum[upto]  # common ones of greater ratio, and those of the first text alone
    less_b = b_sum[upto] + wb.sum() - b.sum()
    return float((1.0 / (more_a / a + less_b / b)).sum())


def verifier(k: int, threshold: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        cache: dict[int, tuple] = {}

        def of(doc, text):
            if doc not in cache:
                if len(cache) >= 64:
                    cache.clear()
                data, at = utf8(pa.array([text], pa.string()))
                _, h, w = weighted(*shingles(*words(data, at), k))
                cache[doc] = h, w
            return cache[doc]

        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            a, b, ok = batch.column("text_u"), batch.column("text_v"), []
            for i in range(len(u)):
                x, y = of(u[i], a[i].as_py()), of(v[i], b[i].as_py())
                if probability_jaccard(*x, *y) >= threshold - 1e-12:
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in ok], pa.int64()), pa.array([v[i] for i in ok], pa.int64())], schema=schema)

    return run


def shingle_lists(k: int):
    """(cls, bytes, elements, weights): a text's different shingles in order, 8 bytes each, and how often each occurs, 4
    bytes each; no weights if all are 1."""
    schema = pa.schema([("cls", pa.int64()), ("bytes", pa.int64()), ("elements", pa.binary()), ("weights", pa.binary())])

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for first, last in chunks(at, 1_000_000):
                row, element, weight = weighted(*shingles(*words(data[at[first] : at[last]], at[first : last + 1] - at[first]), k))
                edge = np.searchsorted(row, np.arange(last - first + 1))
                own = [(element[x:y], weight[x:y].astype(np.float32)) for x, y in zip(edge[:-1], edge[1:])]
                elements = [e.tobytes() for e, _ in own]
                weights = [w.tobytes() if (w != 1).any() else b"" for _, w in own]
                size = [len(e) + len(w) for e, w in zip(elements, weights)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(size, pa.int64()), pa.array(elements, pa.binary()), pa.array(weights, pa.binary())], schema=schema)

    return run


def mass_bounds(x: list, y: list) -> np.ndarray:
    """For each a of x and b of y, lists of (elements, weights): at least their probability Jaccard.

    Let A be the share of a's mass on shingles that b has too, B that of b. The term of a common shingle is at most
    1 / (1/a_i + (1 - B)/b_i), a concave function of degree 1 of (a_i, b_i), so that the sum of the terms is at most
    1 / (1/A + 1/B - 1), which for sets is their similarity itself.
    """
    flat = lambda z: (np.repeat(np.arange(len(z)), [len(e) for e, _ in z]), np.concatenate([e for e, _ in z]), np.concatenate([w / w.sum() for _, w in z]).astype(np.float32))
    (rx, ex, sx), (ry, ey, sy) = flat(x), flat(y)
    both = np.intersect1d(ex, ey)
    if x is y:  # what one text alone has is common to nothing
        e, n = np.unique(ex, return_counts=True)
        both = e[n > 1]
    a, b = np.zeros((len(x), len(y)), np.float32), np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(both), COLUMNS):
        part = both[at : at + COLUMNS]

        def dense(rows, elements, shares, n):
            place = np.minimum(np.searchsorted(part, elements), len(part) - 1)
            ok = part[place] == elements
            share, has = np.zeros((n, len(part)), np.float32), np.zeros((n, len(part)), np.float32)
            share[rows[ok], place[ok]], has[rows[ok], place[ok]] = shares[ok], 1
            return share, has

        share_x, has_x = dense(rx, ex, sx, len(x))
        share_y, has_y = (share_x, has_x) if x is y else dense(ry, ey, sy, len(y))
        a += share_x @ has_y.T
        b += has_x @ share_y.T
    with np.errstate(divide="ignore"):
        return 1 / (1 / a + 1 / b - 1)


def links_within(lists: list, component: np.ndarray, side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Pairs of (elements, weights) that tie together all components linked here; every pair of different components (and
    different sides, if given) is compared, or ruled out by mass_bounds, until its components are tied."""
    root: dict[int, int] = {}

    def find(c):
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    order, out = np.argsort(component, kind="stable"), []
    parts = [order[i : i + TILE] for i in range(0, len(order), TILE)]
    for i, p in enumerate(parts):
        x = [lists[r] for r in p]
        for q in parts[i:]:
            apart = component[p][:, None] != component[q][None, :]
            if side is not None:
                apart &= side[p][:, None] != side[q][None, :]
            if not apart.any():
                continue
            bound = np.where(apart, mass_bounds(x, x if q is p else [lists[r] for r in q]), 0)
            u, v = np.nonzero((np.triu(bound) if q is p else bound) >= threshold - 1e-4)
            for at in np.argsort(-bound[u, v], kind="stable"):
                r, t = int(p[u[at]]), int(q[v[at]])
                a, b = find(int(component[r])), find(int(component[t]))
                if a != b and probability_jaccard(*lists[r], *lists[t]) >= threshold - 1e-12:
                    root[a] = b
                    out.append((r, t))
    return out


def tile_linker(threshold: float):
    """Links of a group of tiles, each (bucket, i, j): two blocks of a bucket's classes, or one with itself."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "cls", "component")}
        e, w = table.column("elements"), table.column("weights")
        order = np.lexsort((column["j"], column["i"], column["bucket"]))
        key = np.stack([column[c][order] for c in ("bucket", "i", "j")])
        edge = np.r_[np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]), len(order)]
        u, v = [], []
        for first, last in zip(edge[:-1], edge[1:]):
            rows = order[first:last]
            lists = []
            for r in rows.tolist():
                elements, weights = np.frombuffer(e[r].as_py(), U64), np.frombuffer(w[r].as_py(), np.float32)
                lists.append((elements, weights.astype(np.float64) if len(weights) else np.ones(len(elements))))
            side = column["block"][rows] if key[1, first] != key[2, first] else None
            for a, b in links_within(lists, column["component"][rows], side, threshold):
                u.append(int(column["cls"][rows[a]]))
                v.append(int(column["cls"][rows[b]]))
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def open_links(members: DataFrame, texts: DataFrame, k: int, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v): links that tie together what is linked within the buckets of ``members`` (bucket, cls, component).

    A bucket's classes are dealt over blocks of about block_bytes of shingles; each two blocks meet in one task, and
    buckets of one block share tasks. Only links leave a task, at most one for each class, never a bucket's pairs.
    """
    held = Stored(texts.mapInArrow(shingle_lists(k), "cls long, bytes long, elements binary, weights binary"))
    sized = cut(members.join(held.read().select("cls", "bytes"), "cls"))
    blocks = cut(sized.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).withColumn("blocks", F.greatest(F.ceil(F.col("bytes") / block_bytes), F.lit(1)).cast("int")))
    packs = max(1, -(-int(blocks.where("blocks = 1").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // block_bytes))
    placed = sized.join(blocks.select("bucket", "blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.xxhash64("bucket", "i", "j"))
    dealt = placed.select(tile.alias("tile"), "bucket", "i", "j", "block", "cls", "component").join(held.read().drop("bytes"), "cls")
    found = cut(dealt.groupBy("tile").applyInArrow(tile_linker(threshold), "u long, v long"))
    held.drop()
    return found


def rename(df: DataFrame, renamed: DataFrame) -> DataFrame:
    return df.join(renamed, "component", "left").withColumn("component", F.coalesce("new", "component")).drop("new")


def united(component: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) after the links found, and (component, new) of those that changed: only components that were
    linked just now meet, all others keep their name."""
    at = lambda n: component.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    linked = found.join(at("u"), "u").join(at("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    renamed = cut(connected_components(linked).where("node != component").select(F.col("node").alias("component"), F.col("component").alias("new")))
    return cut(rename(component, renamed)), renamed


def with_open_buckets(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    several = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return cut(members.join(several, "bucket", "left_semi"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, component_id, kept): class_id is the least doc_id of the same words in the same order,
    component_id the least doc_id reachable over links of probability Jaccard >= threshold, kept whether it is it.

    Each class is compared once. The first round ties every class of a bucket of FIRST_BANDS bands to one leader, by one
    order for all bands, so that a bucket of n gives n - 1 pairs at most and a large group of copies few for each; the
    second does so in all buckets that hold several components then. Leaders leave the buckets that they have led. What
    is in buckets that are still open is compared in blocks (open_links): all of a bucket's classes in different
    components, so two candidates of one bucket are never left uncompared.

    Words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII; shorter texts are one shingle. Null
    texts and texts without words link with nothing. Rows that repeat a doc_id must be the same document, which links
    with itself; null doc_ids stand for themselves, kept, with null ids. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL")
    signed = Stored(named.mapInArrow(signer(bands, rows, k), "doc_id long, same binary, bands array<long>"))
    classes = cut(signed.read().groupBy("same").agg(F.min("doc_id").alias("cls")))
    # a class is signed by its first document; equal words have equal signatures
    own = signed.read().join(classes.select(F.col("cls").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    band = own.select(F.col("doc_id").alias("cls"), F.posexplode("bands").alias("band", "bucket"))
    crowded = band.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut(band.join(crowded, "bucket").withColumn("component", F.col("cls")))
    candidates = cut(members.select(F.col("cls").alias("doc_id")).distinct())
    small = candidates.count() <= BROADCAST_IDS
    texts = Stored(named.join(F.broadcast(candidates) if small else candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    component = candidates.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    tried = None
    for turn in range(LEADER_ROUNDS):
        if members.isEmpty():
            break
        tied = members if turn else members.where(F.col("band") < FIRST_BANDS)
        order = F.xxhash64(F.col("cls"), F.lit(turn))
        leaders = cut(tied.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "cls", "component")).alias("l")).select("bucket", F.col("l.cls").alias("leader"), F.col("l.component").alias("leader_component")))
        pairs = tied.join(leaders, "bucket").where("component != leader_component").select(F.least("cls", "leader").alias("u"), F.greatest("cls", "leader").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = cut(pairs)
        side = lambda n: texts.read().select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}"))
        found = cut(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(verifier(k, threshold), "u long, v long"))
        component, renamed = united(component, found)
        led = members.join(leaders.select("bucket", "leader"), "bucket", "left").where("leader IS NULL OR cls != leader").drop("leader")
        members = with_open_buckets(rename(led, renamed))
        tried = pairs
    if not members.isEmpty():
        rest = members.select(F.col("cls").alias("doc_id")).distinct()
        few = texts.read().join(F.broadcast(rest) if small else rest, "doc_id", "left_semi")
        component, _ = united(component, open_links(members.select("bucket", "cls", "component"), few, k, threshold))
    out = signed.read().select("doc_id", "same").join(classes, "same").join(component.withColumnRenamed("node", "cls"), "cls", "left")
    known = cut(out.select("doc_id", "cls", F.coalesce("component", "cls").alias("component")).dropDuplicates(["doc_id"]))
    texts.drop()
    signed.drop()
    all_docs = docs.select("doc_id").join(known, "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return all_docs.select("doc_id", F.coalesce("cls", "doc_id").alias("class_id"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


# --------------------------------------------------------------------------- query


def op3_minhash_dedup(spark, sf_dir):
    """doc_id, class_id, component_id, kept of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
