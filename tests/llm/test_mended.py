"""What earlier rounds had wrong: prefixes that templates see, headers, places in long texts."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import chat_format, language_id, secrets, warc


def test_template_is_handed_every_prefix():
    seen = []

    def spy(turns):
        seen.append(len(turns))
        return chat_format.plain_template(turns)

    state = chat_format.Renderer(spy)
    for i in range(5):
        assert not state.add("user", f"turn {i}")["rewrites"]
    assert seen == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # each prefix, and each with the probe in its last turn


def test_query_finds_templates_that_rewrite(spark, tmp_path):
    spark.createDataFrame([(1, t, "user", "x") for t in range(3)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def forgetful(turns):
        return chat_format.plain_template([(r, t if i >= len(turns) - 2 else "..") for i, (r, t) in enumerate(turns)])

    assert chat_format.op5_chat_format(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="rewritten"):
        chat_format.op5_chat_format(spark, str(tmp_path), forgetful).collect()


def test_equal_turn_numbers_and_long_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z" * 300000), (1, None, "user", None)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.format_conversations(df).collect(), key=lambda r: r.turn_no)
    assert "".join(r.piece for r in rows) == chat_format.plain_template([("user", ""), ("assistant", "z" * 300000), ("user", "a"), ("user", "b")])


def test_header_forms():
    assert warc.header_fields(["WARC-Type:response", "warc-record-id:   <urn:a>  ", "WARC-Target-URI: http://a/", "  b", "\tc:d", "X:"]) == {"warc-type": "response", "warc-record-id": "<urn:a>", "warc-target-uri": "http://a/ b c:d", "x": ""}
    for bad in (["no field"], [" folded first"], [": no name"]):
        with pytest.raises(ValueError):
            warc.header_fields(bad)


def test_archives_with_other_header_forms(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    head = f"WARC/1.1\r\nwarc-type:response\r\nWARC-RECORD-ID:<urn:1>\r\nWARC-Target-URI: http://a/\r\n very/long\r\nContent-Length:{len(block)}\r\n\r\n".encode()
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(head + block + b"\r\n\r\n"))
    (r,) = warc.read_archives(spark, str(tmp_path), with_payload=True).collect()
    assert (r.record_type, r.payload, r.payload_bytes) == ("response", "body", 4)


def test_places_of_many_tokens_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"{i:040x}" for i in range(n)),)], "text string")
        start = time.time()
        (r,) = df.select(secrets.matches(F.col("text"), "[0-9a-f]{24,}").alias("m")).collect()
        assert len(r.m) == n and (r.m[n - 1].s, r.m[n - 1].e) == (41 * n - 41, 41 * n - 1)
        return time.time() - start

    seconds(100)
    assert seconds(40000) < 5


# --------------------------------------------------------------------------- language models


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def brute_force_fit(words, pieces, rounds):
    number = {p: i for i, p in enumerate(pieces)}
    p = np.full(len(pieces), 1.0 / len(pieces))
    for _ in range(rounds):
        expected = np.full(len(pieces), language_id.PSEUDO_COUNT)
        for word in words:
            ways = [[number[x] for x in s] for s in segmentations(b" " + word, number)]
            shares = np.array([np.prod(p[w]) for w in ways])
            for w, share in zip(ways, shares / shares.sum()):
                np.add.at(expected, w, share)
        p = expected / expected.sum()
    return p


@pytest.mark.parametrize("side_by_side", [48, 4, 0])
def test_expectation_maximisation_equals_all_segmentations(monkeypatch, side_by_side):
    monkeypatch.setattr(language_id, "SIDE_BY_SIDE", side_by_side)
    pieces = sorted([b" a", b"ab", b"abc", b"bc", b"ca", b" b", "é".encode(), b"aa"]) + [bytes([b]) for b in range(256)]
    texts = ["abcab ca. abca", "caab é1abéa", "aaaa abcab"]
    words = [w.encode() for w in "abcab ca abca caab é abéa aaaa abcab".split()]
    got = language_id.fit(texts, language_id.Lookup(pieces), rounds=3)
    assert np.allclose(got, brute_force_fit(words, pieces, 3), rtol=1e-9)


def test_training_words_are_never_cut():
    """In a script without blanks a piece is learnt wherever it stands in a run, also over any fixed border."""
    pieces = sorted([b"abcdefgh", b"xy"]) + [bytes([b]) for b in range(256)]
    lookup = language_id.Lookup(pieces)
    run = "xy" * 20 + "abcdefgh" + "xy" * 3000
    p = language_id.fit([run + "." + run[1:]], lookup)
    long = language_id.fit([run[30:60] + "." + run[31:60]], lookup)
    assert p[pieces.index(b"abcdefgh")] > 0.9 * 2 / 6042 * 0.9 and long[pieces.index(b"abcdefgh")] > 0.02
