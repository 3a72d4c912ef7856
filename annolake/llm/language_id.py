"""Operator 8: language ID by segmentation-marginalised unigrams. Each language has a probability for each piece of a
fixed public vocabulary; a forward algorithm sums over all segmentations of a word into pieces."""

from __future__ import annotations

import math
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from annolake.llm.common import BASE, INVERSE, LOWER, U64, cached_powers, chunks, lengths_to_ids, mix, range_hashes, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training documents of a language at most, those of the least hash; the whole texts of these count.
SAMPLE_DOCS = 400
ROUNDS = 4
PSEUDO_COUNT = 0.1
#: Bytes of text whose different words are scored together.
CHUNK = 1_000_000
#: Words of training texts up to so many bytes go through expectation maximisation side by side, longer ones one by one; no
#: word is cut, in training or after.
SIDE_BY_SIDE = 48
#: Places after which running probabilities of a word are brought back near 1.
RESCALE = 8
#: Bytes beyond which a word is scored by itself: few words are as long, so that going place by place over all of them
#: would take a step for each of its places.
ALONE = 1024
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """All pieces of a sentencepiece model as lower-case UTF-8, a word's beginning as a blank, then all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).replace("▁", " ").encode().translate(LOWER.tobytes()) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    return sorted(p for p in pieces if len(p) > 1 and not p.isspace()) + [bytes([b]) for b in range(256)]


class Lookup:
    """Piece numbers of byte ranges by hash; single bytes are always found."""

    def __init__(self, pieces: list[bytes]):
        self.singles = len(pieces) - 256
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        h = range_hashes(data, end - np.asarray([len(p) for p in pieces]), end)[: self.singles]
        self.order = np.argsort(h)
        self.known = h[self.order]
        self.size = len(pieces)
        self.lengths = sorted({1} | {len(p) for p in pieces})

    def ids(self, data: np.ndarray, total: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """The piece that data[start : start + n] is, -1 for none."""
        if n == 1:
            return self.singles + data[start].astype(np.int64)
        h = mix((total[start + n] - total[start]) * cached_powers(INVERSE, len(data) + 1)[start] + U64(n))
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == h, self.order[at], -1) if len(self.known) else np.full(len(start), -1)


class Words:
    """Different words of some bytes, longest first, each after a blank. A word is a whole run of letters."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = LOWER[data]
        inside = LETTER[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        first = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]][: len(data)]))
        last = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False][: len(data)])) + 1
        self.row = np.searchsorted(at, first, "right") - 1
        _, pick, self.word = np.unique(range_hashes(data, first, last), return_index=True, return_inverse=True)
        first, last = first[pick], last[pick]
        self.length = last - first + 1
        order = np.argsort(-self.length, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.word = back[self.word]
        self.length, first = self.length[order], first[order]
        self.at = np.cumsum(self.length) - self.length
        of = lengths_to_ids(self.length)
        place = first[of] + np.arange(len(of)) - self.at[of] - 1
        self.data = data[np.maximum(place, 0)] if len(place) else data[:0].copy()
        self.data[self.at] = 32
        self.total = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * cached_powers(BASE, len(self.data)), out=self.total[1:])

    def after(self, n: int) -> Words:
        """All words but the n longest."""
        rest = copy(self)
        rest.at, rest.length = self.at[n:], self.length[n:]
        return rest

    def pieces_of(self, word: int, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, size, piece) for all pieces in one word, by end."""
        at, top = int(self.at[word]), int(self.length[word])
        found = []
        for n in lookup.lengths:
            if n <= top:
                end = np.arange(n, top + 1)
                ids = lookup.ids(self.data, self.total, at + end - n, n)
                found.append(np.stack([end, np.full(len(end), n), ids])[:, ids >= 0])
        end, size, ids = np.concatenate(found, 1)
        order = np.argsort(end, kind="stable")
        return end[order], size[order], ids[order]

    def steps(self, lookup: Lookup):
        """(end, size, words, pieces) for all pieces that end in each place of the words."""
        for i in range(1, int(self.length[0]) + 1 if len(self.length) else 1):
            live = int(np.searchsorted(-self.length, -i, "right"))
            for n in lookup.lengths:
                if n > i:
                    break
                ids = lookup.ids(self.data, self.total, self.at[:live] + i - n, n)
                w = np.flatnonzero(ids >= 0)
                if len(w):
                    yield i, n, w, ids[w]


def forward(words: Words, lookup: Lookup, p: np.ndarray) -> np.ndarray:
    """log P(word) for each word and language, over all segmentations. Only as many places as the longest piece has are
    kept, and probabilities are brought back near 1 every few places, so that words may have any length."""
    n_alone = int(np.searchsorted(-words.length, -ALONE, "left"))
    if n_alone:
        log_p, first = np.log(p), []
        for k in range(n_alone):
            end, size, ids = words.pieces_of(k, lookup)
            first.append([_log_sums(int(end[-1]) + 1, 0, end, end - size, log_p[ids, j])[-1] for j in range(p.shape[1])])
        return np.concatenate([np.array(first), forward(words.after(n_alone), lookup, p)])
    top, ring = (int(words.length[0]) if len(words.length) else 0), lookup.lengths[-1] + 1
    alpha = np.zeros((ring, len(words.length), p.shape[1]))
    scale, out = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:])
    alpha[0] = 1

    def ended(i):
        first, last = np.searchsorted(-words.length, [-i, -i + 1], "left")
        if first < last:
            out[first:last] = np.log(alpha[i % ring, first:last]) + scale[first:last]
        if i % RESCALE == 0 and first:
            most = alpha[:, :first].max(0)
            alpha[:, :first] /= most
            scale[:first] += np.log(most)

    now = 0
    for i, n, w, ids in words.steps(lookup):
        if i != now:
            if now:
                ended(now)
            alpha[i % ring, : int(np.searchsorted(-words.length, -i, "right"))] = 0
            now = i
        alpha[i % ring][w] += alpha[(i - n) % ring][w] * p[ids]
    if now:
        ended(now)
    return out if top else np.zeros((0, p.shape[1]))


def side_by_side(words: Words, steps: list, count: np.ndarray, p: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected counts of pieces over all segmentations of short words, all of them at once."""
    top, n_words = (int(words.length[0]) if len(words.length) else 0), len(words.length)
    alpha, beta = np.zeros((top + 1, n_words)), np.zeros((top + 1, n_words))
    alpha[0] = 1
    for i, n, w, ids in steps:
        alpha[i][w] += alpha[i - n][w] * p[ids]
    beta[words.length, np.arange(n_words)] = 1
    for i, n, w, ids in reversed(steps):
        beta[i - n][w] += beta[i][w] * p[ids]
    whole = count / np.maximum(beta[0], 1e-300) if top else count
    for i, n, w, ids in steps:
        expected += np.bincount(ids, weights=alpha[i - n][w] * p[ids] * beta[i][w] * whole[w], minlength=len(p))


def _log_sums(size: int, first: int, to: np.ndarray, of: np.ndarray, log_p: np.ndarray) -> list[float]:
    """The log of the sum, at each place, of what reaches it; ``to`` in the order in which places come."""
    out = [-math.inf] * size
    out[first] = 0.0
    bounds = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    to, of, log_p = to.tolist(), of.tolist(), log_p.tolist()
    for a, b in zip(bounds, bounds[1:]):
        terms = [out[of[j]] + log_p[j] for j in range(a, b)]
        most = max(terms)
        out[to[a]] = most if most == -math.inf else most + math.log(sum(math.exp(t - most) for t in terms))
    return out


def one_by_one(end: np.ndarray, size: np.ndarray, ids: np.ndarray, count: float, p: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected counts of pieces over all segmentations of one word of any length, in logarithms."""
    log_p, top = np.log(p)[ids], int(end[-1])
    alpha = np.array(_log_sums(top + 1, 0, end, end - size, log_p))
    back = np.argsort(size - end, kind="stable")
    beta = np.array(_log_sums(top + 1, top, (end - size)[back], end[back], log_p[back]))
    expected += np.bincount(ids, weights=count * np.exp(alpha[end - size] + log_p + beta[end] - alpha[top]), minlength=len(p))


def fit(texts: list[str], lookup: Lookup, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation maximisation: expected counts of pieces over all segmentations of whole words."""
    data, at = utf8(pa.array(texts, pa.string()))
    words = Words(data, at)
    count = np.bincount(words.word, minlength=len(words.length)).astype(float)
    n_long = int(np.searchsorted(-words.length, -SIDE_BY_SIDE, "left"))
    short, long_ = words.after(n_long), [words.pieces_of(k, lookup) for k in range(n_long)]
    steps = list(short.steps(lookup))
    p = np.full(lookup.size, 1.0 / lookup.size)
    for _ in range(rounds):
        expected = np.full(lookup.size, PSEUDO_COUNT)
        side_by_side(short, steps, count[n_long:], p, expected)
        for k, (end, size, ids) in enumerate(long_):
            one_by_one(end, size, ids, count[k], p, expected)
        p = expected / expected.sum()
    return p


def training_part(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def learn(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS):
    """(pieces, languages, probabilities) from text and lang of training documents: at most ``sample_docs`` of each
    language, those with the least hash of doc_id. Ids are chosen without reading texts, by a limit within groups that
    each task applies first; None if there is nothing to learn from."""
    ids = docs.where(training_part(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang")
    # by their share of a language, about twice as many ids as are wanted come under a bound of the hash: only these are ranked
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = ids.join(F.broadcast(counts), "lang").withColumn("u", unit).where(F.col("u") * F.col("n") < 2 * sample_docs + 100)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id"))
    chosen = near.withColumn("r", rank).where(F.col("r") <= sample_docs).select("doc_id", F.col("lang").alias("l")).distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.col("lang") == F.col("l")).where(F.col("text").rlike(r"\p{L}")).select("lang", "text").toArrow().to_pylist()
    by_lang: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        by_lang.setdefault(r["lang"], []).append(r["text"])
    if not by_lang:
        return None
    pieces = vocabulary(path)
    lookup, names = Lookup(pieces), sorted(by_lang)
    return pieces, names, np.stack([fit(by_lang[x], lookup) for x in names], 1)


def predictor(model, columns: list[str], schema: pa.Schema):
    def run(batches):
        pieces, names, p = model.value
        lookup = Lookup(pieces)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            best, score = [], []
            for first, last in chunks(at, CHUNK):
                words = Words(data[at[first] : at[last]], at[first : last + 1] - at[first])
                log_p = forward(words, lookup, p)
                sums = np.stack([np.bincount(words.row, weights=log_p[words.word, j], minlength=last - first) for j in range(len(names))], 1)
                sums -= sums.max(1, keepdims=True)
                share = np.exp(sums)
                share /= share.sum(1, keepdims=True)
                best.append(share.argmax(1))
                score.append(share.max(1))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            score = np.concatenate(score) if score else np.zeros(0)
            new = {"lang_pred": pa.array(names, pa.string()).take(pa.array(best, pa.int64())), "score": pa.array(score)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c).cast(schema.field(c).type) for c in schema.names], schema=schema)

    return run


def identify(docs: DataFrame, model=None, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus lang_pred and score, the languages' share of the posterior.

    ``model``: what learn() gives; learnt from ``docs`` if None. Only the text is read for a prediction: all its runs
    of letters, A-Z lower-cased. Null texts and texts without a letter get ``und`` and score 0, as do all if nothing
    could be learnt. Documents are never shuffled; the model has a fixed size (pieces times languages) and is
    broadcast. Different words of a stretch of text are scored once. Own columns of the added names are replaced; an
    empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    model = learn(docs, path, sample_docs) if model is None else model
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    keep = docs.columns if keep is None else keep
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("__letter", has_letter)
    fields = [docs.schema[c] for c in keep] + [T.StructField("__letter", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    out = rows.mapInArrow(predictor(spark.sparkContext.broadcast(model), list(keep), to_arrow_schema(schema)), schema)
    return out.select(*keep, F.when(F.col("__letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("__letter"), F.col("score")).otherwise(0.0).alias("score"))


# --------------------------------------------------------------------------- query


def op8_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
