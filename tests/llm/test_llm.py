"""Numbered operators against SQL, brute force, round trips and held-out accuracy, with their edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolake.llm import chat_format, common, decontaminate, embedding_dedup, language_id, line_dedup, minhash, mixing, queries, secrets, url_filter, warc

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def rows_of(df):
    cols = sorted(df.columns)
    return sorted([tuple(str(r[c]) for c in cols) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = con.execute(queries.ORACLES[name])
    names = [x[0] for x in r.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(df.columns)]
    assert rows_of(df) == sorted(tuple(str(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op5_") else 0)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "ß"]) for _ in range(30000))
    rows = [(1, None, None, None, None), (2, "", "en", "b", 0), (None, "some words of a text without id", "en", "a", 3), (3, long, "en", None, 1), (4, long, "en", "a", 1), (4, long, "en", "a", 1), (5, "1234 .. !!", None, "a", 2), (6, "x", "de", "b", 1), (7, "\n\n \n", "de", "b", 1), (8, "x\nx\n" * 3, "de", "b", 1)]
    return spark.createDataFrame(rows, DOCS), rows


# --------------------------------------------------------------------------- 1


def test_url_rules(spark):
    urls = ["HTTP://A.Example.com/en/7x?q#f", "http://example.com/en/8", "x://sub.example.net/de/8", "http://net/de/1", "http://badexample.com/en/7", "nothing", "", None, "a://b://c/d", "http://h?x/y", "http://EXAMPLE.NET/DE/8", "http://m.foo.io/ab/12.html", "http://foo.org/es/", "http://foo.org/es"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_filter.BASE_RULES + url_filter.PATTERN_RULES).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 5, 7, 8, 9)] == [("a.example.com", "/en/7x"), ("", ""), ("", ""), ("b:", "//c/d"), ("h", "")]
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "block"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("mobile-page", "block"), ("org/es/", "block"), (None, "allow")]


def test_url_rules_without_literals_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a/b"), (1, "http://a/b"), (2, None)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.judge_urls(df, [url_filter.Rule("any", "^.", (), "block")]).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow")]


# --------------------------------------------------------------------------- 2


def test_warc_round_trip(spark, tmp_path):
    body = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nü</p>\r\n\r\n"
    rows = [(1, "http://a/ b\n", body), (2, None, body), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300000), (6, "v", "once"), (None, "n", "once"), (6, "v", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for page, _, html in rows:
        assert by[page].payload == (html or "") and by[page].payload_bytes == len((html or "").encode())
    assert [(i, by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5, 6, None)] == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 6)]
    assert by[1].target_uri == "http://a/%20b%0A" and by[2].target_uri is None


def test_warc_members_and_cut_files(spark, tmp_path):
    import gzip

    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nWARC-Source-Row: {i}\r\nContent-Length: {len(body) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{body}\r\n\r\n".encode()
    bodies = ["one", "", "x" * 200000, "four"]
    whole = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))
    (tmp_path / "whole.warc.gz").write_bytes(whole)
    got = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path / "whole.warc.gz"), with_payload=True).collect()}
    assert got == dict(enumerate(bodies))
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-4])
    with pytest.raises(Exception, match="ends within a gzip member"):
        warc.read_archives(spark, str(tmp_path / "cut.warc.gz"), with_payload=True).collect()


# --------------------------------------------------------------------------- 3


def jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def shingles_of(text):
    w = WORDS.findall(low(text))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_groups(texts):
    """{id: component} by exact similarity of all pairs."""
    s = {i: shingles_of(t) for i, t in texts.items()}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in s if s[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a].keys() & s[b].keys() and jaccard(s[a], s[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def near_texts(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    texts, i = {}, 0
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[i] = " ".join(w)
            i += 1
    return texts


def test_minhash_equals_brute_force(spark):
    texts = near_texts()
    texts |= {1000: None, 1001: "", 1002: "a b", 1003: "A, b!", 1004: "...", 1005: "rep " * 500, 1006: "rep " * 900}
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_groups(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[1003].class_id == 1002 and got[1006].component_id == 1005


def test_probability_jaccard_formula():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = {int(k): float(v) for k, v in zip(rng.choice(20, 8, replace=False), rng.integers(1, 5, 8))}
        b = {int(k): float(v) for k, v in zip(rng.choice(20, 9, replace=False), rng.integers(1, 5, 9))}
        arr = lambda d: (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)]))
        assert abs(minhash.probability_jaccard(*arr(a), *arr(b)) - jaccard(a, b)) < 1e-9


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    common_part, own = rng.integers(1, 2**63, 90, dtype=np.uint64), rng.integers(1, 2**63, 20, dtype=np.uint64)
    a, b = np.concatenate([common_part, own[:10]]), np.concatenate([common_part, own[10:]])
    row, h = np.repeat([0, 1], 100), np.concatenate([a, b])
    row, h, w = minhash.weighted(row, h)
    s = minhash.signatures(row, h, w, 2, 4096)
    assert abs((s[0] == s[1]).mean() - 90 / 110) < 0.03


def test_minhash_awkward_and_hot(spark):
    df, rows = awkward(spark)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 3 and not by[4].kept and by[1].kept and by[None].kept
    base = ["w%d" % i for i in range(100)]
    hot = [(i, " ".join(base[:50] + ["x%d" % i] + base[51:])) for i in range(400)]
    assert {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(hot, "doc_id long, text string")).collect()} == {0}


def test_minhash_crowd_just_under_the_threshold(spark):
    """1,000 documents at 0.78 to each other by a shared passage, 40 of them in pairs at 0.816."""
    passage = " ".join("t%d" % i for i in range(82))
    own = {i: ["o%dx%d" % (i, j) for j in range(11)] for i in range(1000)}
    for i in range(0, 40, 2):
        own[i + 1][:2] = own[i][:2]
    docs = [(i, f"{passage} {' '.join(w)}") for i, w in own.items()]
    assert abs(jaccard(shingles_of(docs[50][1]), shingles_of(docs[51][1])) - 0.78) < 1e-9
    assert 0.8 < jaccard(shingles_of(docs[0][1]), shingles_of(docs[1][1])) < 0.82
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 if i < 40 else i for i in own}


def test_open_buckets_in_small_blocks(spark):
    """Whatever the blocks, the same components are tied, and no link is below the threshold."""
    rng = random.Random(3)
    base = ["b%d" % i for i in range(120)]
    docs = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = "e%d" % rng.randrange(400)
        docs[i] = " ".join(w)
    texts = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    members = spark.createDataFrame([(b, i, i) for b in (1, 2) for i in docs], "bucket long, cls long, component long")
    shingles = {i: shingles_of(t) for i, t in docs.items()}
    want = {frozenset((i, j)) for i in docs for j in docs if i < j and jaccard(shingles[i], shingles[j]) >= 0.8}
    roots = []
    for size in (1 << 30, 9000):
        links = [(r.u, r.v) for r in minhash.open_links(members, texts, 5, 0.8, size).collect()]
        assert {frozenset(x) for x in links} <= want
        root = {i: i for i in docs}
        for u, v in links:
            a, b = root[u], root[v]
            root = {i: min(a, b) if r in (a, b) else r for i, r in root.items()}
        assert all(root[min(x)] == root[max(x)] for x in want)
        roots.append(root)
    assert roots[0] == roots[1] and len(set(roots[0].values())) > 1


# --------------------------------------------------------------------------- 4


def test_mix_targets_and_budgets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "c", None, "hot", "hot", "hot", "Z", "é"])) for i in range(800)] + [(9000, None, "none"), (7, "w w", "a"), (7, "w w", "a"), (None, "w", "a")]
    out = mixing.mix_sources(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")).collect()
    assert len(out) == len(rows)
    size, names = collections.Counter(), sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target |= {s: 3.0 * size[s] for s in capped}
    taken = collections.Counter()
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    again = mixing.mix_sources(spark.createDataFrame([(*r, 1) for r in reversed(rows)], "doc_id long, text string, source string, x int").repartition(7))
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(out) == key(again.collect())


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix_sources(df).collect()] == [(0, 0.0)] * 2


# --------------------------------------------------------------------------- 5


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["\\", "#", "### user:\n", " </turn>\n", "<", ":", "a", "\n", "é", "😀", "qZ7probe7Zq", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "sy:#s", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in (1, 2, None, 3) for t in range(40 if c != 3 else 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).mapInArrow(chat_format.digester(chat_format.read_plain), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    for c in (1, 2, None, 3):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat_format.plain_template(own))


def test_chat_spans_and_rewrites(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "hm")], "conv_id long, turn long, role string, text string")
    whole = chat_format.plain_template([("user", "hi"), ("assistant", "yo"), ("user", "hm")])
    rows = sorted(chat_format.format_conversations(df).collect(), key=lambda r: r.turn_no)
    assert "".join(r.piece for r in rows) == whole and [whole[r.text_start : r.text_end] for r in rows] == ["hi", "yo", "hm"]
    assert [r.loss for r in rows] == [False, True, False] and not any(r.rewrites for r in rows)

    def forgetful(turns):
        return "".join(f"<{r}>{t if i >= len(turns) - 2 else '..'}\n" for i, (r, t) in enumerate(turns))

    rows = sorted(chat_format.format_conversations(df, forgetful).collect(), key=lambda r: r.turn_no)
    assert [r.rewrites for r in rows] == [False, False, True] and rows[2].text_start is None
    text = ""
    for r in rows:
        text = text[: len(text) - r.dropped] + r.piece
    assert text == forgetful([("user", "hi"), ("assistant", "yo"), ("user", "hm")])


def test_chat_templates_see_all_of_a_long_conversation(spark):
    turns = [("system", "be brief")] + [("assistant" if i % 2 else "user", "t%d" % i) for i in range(150)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")

    def numbered(turns):
        assert turns[0][0] == "system" and all(r == ("assistant" if i % 2 else "user") for i, (r, _) in enumerate(turns[1:]))
        return f"[{turns[0][1]}]" + "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))

    def late(turns):
        return "".join(f"{t if len(turns) <= 120 or i else 'gone'}\n" for i, (_, t) in enumerate(turns))

    for template in (numbered, late):
        rows = sorted(chat_format.format_conversations(df, template).collect(), key=lambda r: r.turn_no)
        text = ""
        for r in rows:
            text = text[: len(text) - r.dropped] + r.piece
        assert text == template(turns)
        assert [r.turn_no for r in rows if r.rewrites] == ([120] if template is late else [])


# --------------------------------------------------------------------------- 6


def test_embeddings_edge_cases_and_tiles(spark):
    rng = np.random.default_rng(4)
    center = rng.standard_normal((5, 16))
    rows = [(i, (center[i % 5] + 0.05 * rng.standard_normal(16)).tolist(), i) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)] + [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [1.0] * 15 + [None], 0), (304, [float("nan")] * 16, 0), (305, [1.0] * 15 + [float("inf")], 0), (306, [1.0] * 8, 0), (307, [2.0] * 8, 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, window=16, passes=40).collect()}
    assert len(got) == len(rows)
    ok = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for i, x in ok.items():
        links = [j for j, y in ok.items() if j != i and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9]
        assert got[i].n_links == len(links), i
        assert got[i].component_id == min([i, *links])
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (300, 302, 304, None)] == [(0, 300, True), (0, 302, True), (0, 304, True), (0, None, True)]


def test_embeddings_in_a_dense_group(spark):
    """2,000 vectors of which 1,000 are at cosine 0.8 to each other, and lone and grouped pairs at 0.91."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((2000, 256)))
    center = unit(rng.standard_normal(256))
    x[:1000] = unit(np.sqrt(0.8) * center + np.sqrt(0.2) * unit(x[:1000] - np.outer(x[:1000] @ center, center)))
    for i in [*range(0, 60, 2), *range(1000, 1060, 2)]:
        off = unit(rng.standard_normal(256))
        off = unit(off - (off @ x[i]) * x[i])
        x[i + 1] = 0.91 * x[i] + np.sqrt(1 - 0.91**2) * off
    link = np.triu(x @ x.T >= 0.9, 1)
    assert link.sum() == 60
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, window=32).collect()}
    for u, v in zip(*np.nonzero(link)):
        assert got[v].component_id == u and (got[u].n_links, got[v].n_links) == (1, 1)
    assert sum(r.n_links for r in got.values()) == 120


def test_one_pass_compares_neighbour_slots_over_the_borders_of_blocks(spark):
    """Vectors around a circle, each near its neighbours alone: one pass in slots of two, cut into blocks, chains all."""
    angle = np.linspace(0, np.pi / 2, 200)
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cls long, embedding array<double>")
    links, gain = embedding_dedup.sorted_passes(df, 0.9, 1, 4, 6)
    links = [(r.u, r.v) for r in links.collect()]
    assert gain.count() == len(x)
    assert all(x[u] @ x[v] >= 0.9 - 1e-12 for u, v in links)
    label = embedding_dedup.forest(len(x), *np.array(links).T)
    # blocks hold 16 vectors of their own: without the slot that they borrow there would be at least 13 chains
    assert len(set(label)) == 1


# --------------------------------------------------------------------------- 7


def base_spans(text):
    out = []
    for k, (rx, ok) in enumerate([(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(rx, text) if ok(m)]
    return sorted(out)


def test_secrets_base_equals_regular_expressions(spark):
    rng = random.Random(9)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ": ", " = ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "😀", " ", "\n", "x", "AB"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "password=" + "a" * 50000, "a" * 24, "A" * 24 + "\u0001" + "f" * 30]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(x.s, x.k, x.e) for x in got[i].base] == base_spans(t or ""), t


def test_battery_tells_random_tokens_from_words(spark):
    rng = random.Random(11)
    alphabets = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    keys = ["".join(rng.choice(a) for _ in range(40)) for a in alphabets.values() for _ in range(60)]
    words = ["".join(rng.choice(["the", "ing", "erna", "tion", "keit", "lich"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(i, f"ab {t} cd") for i, t in enumerate(keys + words)], "doc_id long, text string")
    got = {r.doc_id: r.random for r in secrets.find_secrets(df).collect()}
    assert sum(bool(got[i]) for i in range(len(keys))) >= 0.8 * len(keys)
    assert not any(got[i] for i in range(len(keys), len(keys) + len(words)))
    hit = next(got[i] for i in range(len(keys)) if got[i])[0]
    assert (hit.s, hit.e, hit.kind) == (3, 43, "random")


def test_random_tokens_of_each_alphabet_are_found(spark):
    rng = random.Random(12)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base36": lower + digits, "base32": lower + "234567", "letters": lower, "upper": lower.upper(), "base62": lower + lower.upper() + digits, "base64": lower + lower.upper() + digits + "+/"}
    rows = [(name, n, "".join(rng.choice(a) for _ in range(n))) for name, a in alphabets.items() for n in (16, 32, 64, 128) for _ in range(50)]
    rows += [("text", n, "".join(rng.choice(["the", "ing", "erna", "tion", "keit", "lich", "schaft", "ver", "en", "ment", "ado", "que"]) for _ in range(n))[:n]) for n in (16, 32, 64, 128) for _ in range(100)]
    df = spark.createDataFrame([(i, f"ab {t} cd") for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: bool(r.random) for r in secrets.find_secrets(df).collect()}
    share = collections.defaultdict(list)
    for i, (name, n, _) in enumerate(rows):
        share[name, n].append(got[i])
    share = {k: sum(v) / len(v) for k, v in share.items()}
    print(share)
    for (name, n), found in share.items():
        least = {"base36": 0.5, "base62": 0.9, "base64": 0.9}.get(name, 0.0) if n == 16 else 0.6 if n == 32 else 0.9
        assert found <= 0.02 if name == "text" else found >= least, (name, n, found)


# --------------------------------------------------------------------------- 8


def test_language_id_held_out(spark):
    rows = language_id.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_language_id_edge_cases(spark):
    df, rows = awkward(spark)
    train = spark.createDataFrame([(i, "the of and " * 5 if i % 2 else "der die und " * 5, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("score", F.lit("x")), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 5, 7)] == ["und"] * 4 and 0 <= got[3].score <= 1
    assert language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred = 'und'").count() == len(rows)
    long = spark.createDataFrame([(1, "q" * 200000), (2, "é" * 100000)], "doc_id long, text string")
    assert {r.lang_pred for r in language_id.identify(long, model).collect()} <= {"en", "de"}


def test_forward_sums_all_segmentations():
    pieces = [b" a", b" ab", b"ab", b"bc"] + [bytes([b]) for b in range(256)]
    p = np.random.default_rng(0).random((len(pieces), 1))
    data = np.frombuffer(b"abc", np.uint8)
    words = language_id.Words(data, np.array([0, 3]))
    table = {x: p[i, 0] for i, x in enumerate(pieces)}

    def total(s):
        return 1.0 if not s else sum(table[s[:n]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in table)

    assert abs(np.exp(language_id.forward(words, language_id.Lookup(pieces), p))[0, 0] - total(b" abc")) < 1e-12


def test_forward_over_long_runs():
    """Runs of any length, in any script, equal a plain sum in logarithms; pieces of any length count."""
    pieces = language_id.vocabulary()
    lookup = language_id.Lookup(pieces)
    assert max(map(len, pieces)) > 16
    p = np.random.default_rng(0).dirichlet(np.ones(lookup.size) * 0.1, 2).T
    texts = ["日本語のテキスト" * 60, "x" * 700, "internationalisation " * 2 + "нормализованный"]
    data, at = common.utf8(pa.array(texts))
    words = language_id.Words(data, at)
    got = language_id.forward(words, lookup, p)
    table = {x: np.log(p[i]) for i, x in enumerate(pieces)}
    for text, word in [(0, texts[0]), (1, texts[1]), (2, "нормализованный")]:
        b = b" " + word.encode()
        at = np.full((len(b) + 1, 2), -np.inf)
        at[0] = 0
        for i in range(1, len(b) + 1):
            for n in lookup.lengths:
                if n <= i and b[i - n : i] in table:
                    at[i] = np.logaddexp(at[i], at[i - n] + table[b[i - n : i]])
        mine = [got[w] for w in words.word[words.row == text] if words.length[w] == len(b)]
        assert np.allclose(mine[0], at[-1])


# --------------------------------------------------------------------------- 9


def brute_contamination(text, items):
    w = WORDS.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        iw = WORDS.findall(low(t))
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["A", "b", "c9", "été", "D"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for i in range(12)] + [(12, None), (3, say(12)), (13, "unusual words in a row that are said nowhere else than here and there")]
    docs = [(i, say(rng.randint(0, 60)) + ("; " + rng.choice(items[4:12])[1].upper() if i % 3 == 0 else "")) for i in range(80)] + [(90, None), (91, ""), (92, "x Unusual words, in a row that are said nowhere. y"), (92, "again")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute_contamination(t or "", items)) for i, t in docs)
    for most in (1_000_000, 30):
        monkeypatch.setattr(decontaminate, "blocks", lambda bench, n, k, m=most: REAL_BLOCKS(bench, n, k, m))
        got = decontaminate.find_contamination(d, b).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == want
        assert all(sum(y - x for x, y in zip(r["runs"][::2], r["runs"][1::2])) == r.n_hit for r in got)


REAL_BLOCKS = decontaminate.blocks


# --------------------------------------------------------------------------- 10


def brute_lines(docs):
    strip = " \t\n\v\f\r"
    at = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            at[low(x.strip(strip))].add(-1 if i is None else i)
    gone = {k: max(v) for k, v in at.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(low(x.strip(strip)), i if i is not None else -1) == (-1 if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize(("bits", "broadcast_keys"), [(1 << 26, 1000), (1 << 10, 1000), (1 << 10, 3)])
def test_lines_equal_brute_force(spark, bits, broadcast_keys):
    rng = random.Random(6)
    pool = ["this line is said by many " + "x" * i for i in range(12)] + ["  THIS line is said by many \t\r", "short one", "é" * 20, "é" * 19, "", "   ", "y" * 5000]
    docs = [(i, "\n".join(rng.choice(pool + ["line %d of its own, only here" % rng.randrange(10**9)]) for _ in range(rng.randint(0, 9)))) for i in range(70)]
    docs += [(None, "this line is said by many \nz"), (500, None), (501, ""), (502, "\n" * 3), (69, pool[0]), (69, pool[0])]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_lines string").repartition(5)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(df, bits=bits, broadcast_keys=broadcast_keys).collect())
    assert got == brute_lines(docs)


# --------------------------------------------------------------------------- shared


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5)] + [(100 + i, 101 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[3] == 1 and got[11] == 10 and got[160] == 100 and got[1199] == 1000 and 5 not in got


# --------------------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force(spark):
    import pandas as pd

    import corpus_pipeline

    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    kept = {int(i): t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in docs])}
    group = brute_groups(kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [r for r in docs if group[r.doc_id] == r.doc_id and not brute_contamination(kept[r.doc_id], items)[1]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, kept[r.doc_id], r.source) for r in left], columns=["doc_id", "text", "source"]))
    want = sorted((r[0], r[1], r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall())
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in out) == want
    assert all(r.text == kept[r.doc_id] and r.n_chars == len(r.text) for r in out)


def test_pipeline_stages_on_awkward_documents(spark):
    import corpus_pipeline

    docs, rows = awkward(spark)
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mix_sources":
            assert out.schema == docs.schema
            docs = spark.createDataFrame(out.collect(), docs.schema)
        ids.append(sorted(str(r.doc_id) for r in out.collect()))
    assert ids[0] == ["3", "4", "4", "6", "8", "None"] and ids[1] == ids[0]
    assert ids[2] == ["3", "6", "8", "None"]


def test_pipeline_keeps_documents_when_no_language_can_be_learnt(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words"), (2, "12 .."), (3, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [1]
