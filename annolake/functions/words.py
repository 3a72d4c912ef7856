"""Words of texts and their BIO tags, for Arrow batches as a whole: what a batch holds is one run of bytes, in which numpy
finds where words begin and end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

WORDS = "array<struct<start:int,end:int,text:string>>"
#: Bytes of text that are looked at together (one text at least).
PART = 4_000_000

_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])
#: White space beyond ASCII, as Java's (?U)\s has it, by its first byte.
_LONG = [(first, np.array([[*chr(c).encode()[1:]] for c in chars], np.uint8)) for first, chars in ((0xC2, [0x85, 0xA0]), (0xE1, [0x1680]), (0xE2, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]), (0xE3, [0x3000]))]


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _BLANK[data]
    for first, rest in _LONG:
        at = np.flatnonzero(data == first)
        n = rest.shape[1]
        at = at[at + n < len(data)]
        if len(at):
            own = data[at[:, None] + np.arange(1, n + 1)]
            at = at[(own[:, None, :] == rest).all(2).any(1)]
            for i in range(n + 1):
                out[at + i] = True
    return out


class Words:
    """The words of some texts. ``bounds``: the place of each text's first word among all, and their number; ``start`` and
    ``end`` in code points from the first text's begin, each text beginning at ``base``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, values = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = ~_blank(data)
        edges = at[:-1][at[1:] > at[:-1]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]  # that of the first text, the last byte of all, is so already
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        self.bounds = np.searchsorted(begin, at)
        self.base, self.start, self.end = before[at[:-1]], before[begin], before[stop]
        self._data, self._sizes = data[inside], stop - begin

    def rows(self) -> pa.Array:
        """As in WORDS."""
        base = np.repeat(self.base, np.diff(self.bounds))
        offsets = np.concatenate([[0], np.cumsum(self._sizes)]).astype(np.int32)
        text = pa.StringArray.from_buffers(len(self.start), pa.py_buffer(offsets), pa.py_buffer(self._data))
        fields = [pa.array((self.start - base).astype(np.int32)), pa.array((self.end - base).astype(np.int32)), text]
        return pa.ListArray.from_arrays(pa.array(self.bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end", "text"]))

    def tags(self, spans: pa.Array) -> pa.Array:
        """A tag for each word; null where ``spans`` are null.

        Spans go by start, longest first. Those before a span begin no later than it does, so of its words they have all
        up to the last that any of them reaches, and what is left to it are words in a row.
        """
        each, count = spans.flatten(), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
        start, end = (pc.struct_field(each, x).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "end"))
        label = pc.struct_field(each, "label").dictionary_encode(null_encoding="encode")
        row = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((start - end, start, row))
        row, start, end, kind = row[order], start[order], end[order], label.indices.to_numpy(zero_copy_only=False)[order]
        low, high = self.bounds[row], self.bounds[row + 1]
        a = np.clip(np.searchsorted(self.end, self.base[row] + start, "right"), low, high)
        b = np.clip(np.searchsorted(self.start, self.base[row] + end, "left"), low, high)
        if len(b):
            a[1:] = np.maximum(a[1:], np.maximum.accumulate(b)[:-1])
        a, b, kind = a[a < b], b[a < b], kind[a < b]
        code = np.zeros(len(self.start), np.int32)
        size = b - a
        code[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(2 * kind + 2, size)
        code[a] = 2 * kind + 1
        names = ["O", *(None if x is None else p + x for x in label.dictionary.to_pylist() for p in ("B-", "I-"))]
        tags = pa.array(names, pa.string()).take(pa.array(code))
        return pa.ListArray.from_arrays(pa.array(self.bounds.astype(np.int32)), tags, mask=spans.is_null() if spans.null_count else None)


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of PART bytes."""
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PART, "right")))
        yield a, b
        a = b


def words(text: Column) -> Column:
    """WORDS of a text: runs of other than white space and their places in code points; none of null."""

    def find(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([Words(texts.slice(a, b - a)).rows() for a, b in _cuts(texts)] or [Words(texts).rows()])

    return F.arrow_udf(find, WORDS)(text)


def _given(docs: DataFrame, keep: list[str], tags: dict[str, str]) -> DataFrame:
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))
    return docs.select(*keep, F.col("text").alias("__text"), *[F.transform(spans, place).alias(f"__{name}") for name, spans in tags.items()])


def tagged_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, WORDS of its texts as ``tokens``, and ``tags``: a BIO tag by ``spans`` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _cuts(batch.column("__text")):
                part = batch.slice(a, b - a)
                w = Words(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), w.rows(), w.tags(part.column("__tags"))], [*keep, "tokens", "tags"])

    schema = StructType([*(docs.schema[x] for x in keep), *StructType.fromDDL(f"tokens {WORDS}, tags array<string>")])
    return _given(docs, keep, {"tags": "spans"}).mapInArrow(run, schema)


def tagged_words(docs: DataFrame, keep: list[str], tags: dict[str, str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and a row for each word: its place n in the text, start, end, text and BIO tags by the
    columns of spans that ``tags`` names (tag -> spans). Documents without spans, null, give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _cuts(batch.column("__text")):
                part = batch.slice(a, b - a)
                for name in tags:
                    part = part.filter(part.column(f"__{name}").is_valid())
                w = Words(part.column("__text"))
                count = np.diff(w.bounds)
                row = pa.array(np.repeat(np.arange(part.num_rows), count))
                n = pa.array((np.arange(len(w.start)) - np.repeat(w.bounds[:-1], count)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(x).take(row) for x in keep), n, *w.rows().values.flatten(), *(w.tags(part.column(f"__{x}")).values for x in tags)], [*keep, "n", "start", "end", "text", *tags])

    schema = StructType([*(docs.schema[x] for x in keep), *StructType.fromDDL("n int, start int, end int, text string"), *(StructField(x, StringType()) for x in tags)])
    return _given(docs, keep, tags).mapInArrow(run, schema)
