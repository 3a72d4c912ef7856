"""Work that must not grow with the square of a document, nor shuffle texts: against brute force, by time and by plan."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from annolake.operators import corpus, evaluate, output, resolve, tagging
from annolake.schema import SPANS


def spans_of(n, most, seed, width=10):
    rng = random.Random(seed)
    return [(a, a + rng.randint(1, most), rng.choice("ABC"), rng.choice([None, 0.3, 0.6, 0.9]), rng.choice(["s", "t", None])) for a in (rng.randrange(max(1, n * width)) for _ in range(n))]


def one_document(spark, spans):
    return spark.createDataFrame([(1, spans)], f"doc_id int, spans {SPANS}")


def greedy(spans, key, clash=lambda a, b: True):
    kept = []
    for _, s in sorted(enumerate(spans), key=lambda p: (*key(p[1]), p[0])):
        if not any(s[0] < k[1] and k[0] < s[1] and clash(k, s) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[0], s[1], s[2]))


@pytest.mark.parametrize("seed,most", [(1, 4), (2, 15), (3, 60)])
def test_greedy_equals_pairwise_comparison(spark, seed, most):
    spans = spans_of(120, most, seed)
    df = one_document(spark, spans)
    found = lambda f, **o: [tuple(s) for s in df.select(f(F.col("spans"), **o).alias("s")).first().s]
    length = lambda s: s[0] - s[1]
    assert found(resolve.longest) == greedy(spans, lambda s: (length(s),))
    assert found(resolve.longest_leftmost) == greedy(spans, lambda s: (length(s), s[0]))
    assert found(resolve.for_replacement) == greedy(spans, lambda s: (length(s), s[0], s[2]))
    assert found(resolve.max_confidence) == greedy(spans, lambda s: (-(1.0 if s[3] is None else s[3]),))
    votes = lambda s: {o[4] or "" for o in spans if o[2] == s[2] and o[0] < s[1] and s[0] < o[1]}
    assert found(resolve.consensus, threshold=2, groups="source") == greedy([s for s in spans if len(votes(s)) >= 2], lambda s: (s[0], length(s)), lambda a, b: a[2] == b[2])


@pytest.mark.parametrize("f", ["longest", "left_to_right", "reconcile", "for_replacement", "exact_dedupe"])
@pytest.mark.parametrize("most", [8, 60])
def test_resolving_takes_about_linear_time(spark, f, most):
    def seconds(n):
        df = one_document(spark, spans_of(n, most, n))
        start = time.time()
        df.select(F.size(getattr(resolve, f)(F.col("spans")))).first()
        return time.time() - start

    seconds(50)
    assert seconds(8000) < 2  # the pairwise form took 8 s and 64,000,000 comparisons


def test_replacement_and_merging_of_many_spans(spark):
    n = 8000
    text = "ab " * n
    spans = [(3 * i, 3 * i + 2, "NAME", None, None) for i in range(n)]
    df = spark.createDataFrame([(1, text, spans)], f"doc_id int, text string, spans {SPANS}")
    start = time.time()
    r = df.select(output.replaced(F.col("text"), F.col("spans"), lambda s: F.lit("[N]")).alias("r")).first().r
    assert r.text == "[N] " * n and [tuple(s)[:2] for s in r.spans[-2:]] == [(4 * n - 8, 4 * n - 5), (4 * n - 4, 4 * n - 1)]
    (m,) = tagging.merge_adjacent(df).first().spans
    assert (m.start, m.end) == (0, 3 * n - 1) and time.time() - start < 20


def flat_rows(spark, docs):
    rows = [(d, i, *s) for d, spans in docs.items() for i, s in enumerate(spans)]
    return spark.createDataFrame(rows, "doc_id int, span_ord int, start int, end int, label string, confidence double, source string")


@pytest.mark.parametrize("seed", [1, 2])
def test_character_tags_equal_a_walk_over_characters(spark, seed):
    pred, gold = ({d: spans_of(40, 12, 10 * seed + d + side, 4) for d in range(4) if d != side} for side in (0, 1))

    def tags(spans):
        out = {}
        for _, s in sorted(enumerate(spans), key=lambda p: (p[1][0], p[1][0] - p[1][1], p[0])):
            for at in range(s[0], s[1]):
                out.setdefault(at, ("B-" if at == s[0] else "I-") + s[2])
        return out

    got = {(r.doc_id, r.pos): r.tag for r in evaluate.char_tags(flat_rows(spark, pred)).collect()}
    assert got == {(d, at): t for d, spans in pred.items() for at, t in tags(spans).items()}
    want = {}
    for d in range(4):
        p, g = tags(pred.get(d, [])), tags(gold.get(d, []))
        want[d] = (sum(p[at] == g.get(at) for at in p), sum(p[at] != g.get(at) for at in p), sum(g[at] != p.get(at) for at in g))
    rows = evaluate.characters(flat_rows(spark, pred), flat_rows(spark, gold), by_doc=True).collect()
    assert {r.doc_id: (r.tp, r.fp, r.fn) for r in rows} == want


def test_character_tags_shuffle_boundaries_once(spark):
    df = flat_rows(spark, {1: [(0, 10**6, "A", None, None)], 2: [(5, 10**6, "B", None, None)]})
    plan = evaluate.characters(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "sequence" not in plan
    r = evaluate.characters(df, df).first()
    assert (r.tp, r.fp, r.fn) == (2 * 10**6 - 5, 0, 0)


def test_one_document_of_20000_spans_is_compared_by_islands(spark):
    def side(seed):
        rng = random.Random(seed)
        return [(10 * i + rng.randint(0, 2), 10 * i + rng.randint(5, 9), rng.choice("AB"), None, None) for i in range(20000)]

    pred, gold = flat_rows(spark, {1: side(1)}), flat_rows(spark, {1: side(2)})
    start = time.time()
    r = evaluate.partial(pred, gold).first()
    c = {(x.gold_label, x.pred_label): x.n for x in evaluate.confusion(pred, gold).collect()}
    assert time.time() - start < 25
    same = sum(a[2] == b[2] for a, b in zip(side(1), side(2)))
    assert (r.tp, r.fp, r.fn) == (same, 20000 - same, 20000 - same) and sum(c.values()) == 20000 and c["A", "A"] + c["B", "B"] == same


# --------------------------------------------------------------------------- cuts by rank


def shuffled_columns(df):
    """Names of the columns of all shuffles of a plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    inputs = re.findall(r"\) Exchange\n(?:Input.*: \[(.*)\])", plan)
    return {re.sub(r"#.*", "", c.strip()) for columns in inputs for c in columns.split(",")}, "Exchange" in plan


def test_texts_stay_where_they_are(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    for df in (corpus.resize(docs, 150), corpus.reassign_splits(docs, {"a": 0.7, "b": 0.3}), corpus.reassign_splits(docs, {"a": 0.7, "b": 0.3}, shuffle=False), corpus.proportional(docs, {"web": 2.0, "s0": 1.0, **{r[0]: 1.0 for r in docs.select("source").distinct().collect()}}, 40)):
        columns, _ = shuffled_columns(df)
        assert "text" not in columns, columns
    columns, some = shuffled_columns(corpus.ranked(docs, F.md5(F.col("doc_id").cast("string"))))
    assert some and "text" in columns  # what the test would find


@pytest.mark.parametrize("n", [0, 1, 7, 40, 60])
def test_resize_takes_exactly_n_also_of_repeated_ids(spark, n):
    docs = spark.createDataFrame([(i % 20, f"t{i}") for i in range(60)], "doc_id long, text string").repartition(5)
    got = corpus.resize(docs, n).collect()
    assert len(got) == n and len({(r.doc_id, r.text) for r in got}) == n
    order = sorted({i for i in range(20)}, key=lambda i: __import__("hashlib").md5(f"42:{i}".encode()).hexdigest())
    assert {int(r.doc_id) for r in got} <= set(order[: -(-n // 3)])


@pytest.mark.parametrize("shuffle", [True, False])
def test_splits_have_exact_sizes_also_of_repeated_ids(spark, shuffle):
    docs = spark.createDataFrame([(i % 25, f"t{i}") for i in range(101)], "doc_id long, text string").repartition(4)
    rows = corpus.reassign_splits(docs, {"train": 0.7, "none": 0.0, "valid": 0.2, "test": 0.1}, shuffle=shuffle).collect()
    sizes = {k: sum(r.split == k for r in rows) for k in ("train", "valid", "test")}
    assert len(rows) == 101 and list(sizes.values()) == corpus.largest_remainder(101, [0.7, 0.2, 0.1])
    if not shuffle:
        assert max(r.doc_id for r in rows if r.split == "train") <= min(r.doc_id for r in rows if r.split == "test")


def test_proportional_takes_null_sources_and_all_of_small_ones(spark):
    docs = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 53 else None) for i in range(80)], "doc_id long, source string")
    rows = corpus.proportional(docs, {"a": 1.0, "b": 1.0, None: 1.0, "missing": 5.0}, 30).collect()
    count = lambda k: sum(r.source == k for r in rows)
    assert len(rows) == 30 and count("b") == 3 and count("a") + count(None) == 27 and count("a") >= 10 and count(None) >= 10
