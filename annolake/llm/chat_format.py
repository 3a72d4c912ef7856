"""Operator 5: chat formatting by incremental black-box rendering. A template is any function from turns to text;
successive turn prefixes are rendered, consecutive outputs compared, and what the new turn added is its span. Templates
that change what they had already written are found and marked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Stands in for a turn's text to find where the template puts it; no template changes plain letters and digits.
PROBE = "qZ7probe7Zq"

SPECIAL = re.compile(r"[\\#<:]")
TURN = re.compile(r"### ([^\\#<:]*(?:\\.[^\\#<:]*)*):\n([^\\#<:]*(?:\\.[^\\#<:]*)*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_plain(piece: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn in output of plain_template; the places are of the escaped text."""
    found, at = [], 0
    for m in TURN.finditer(piece):
        if m.start() != at:
            raise ValueError("the output doesn't read back as turns")
        at = m.end()
        found.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
    if at != len(piece):
        raise ValueError("the output doesn't read back as turns")
    return found


def plain_turn(role: str, text: str) -> str:
    return f"### {escape(role)}:\n{escape(text)} </turn>\n"


#: Short turns are escaped once, however many prefixes hold them: 16,384 turns of at most 10,000 characters.
short_turn = lru_cache(maxsize=1 << 14)(plain_turn)


def plain_template(turns: list[Turn]) -> str:
    """``### role:``, the text, `` </turn>``; backslash, #, < and : of roles and texts are escaped by a backslash."""
    return "".join((short_turn if len(text) <= 10_000 else plain_turn)(role, text) for role, text in turns)


class Renderer:
    """The state of one conversation: its turns, the last output, and how far the whole output has come. The template is
    handed every prefix of the turns, and each output is compared with the one before."""

    def __init__(self, template: Template):
        self.template = template
        self.turns: list[Turn] = []
        self.shown = ""
        self.length = 0

    def add(self, role: str, text: str) -> dict:
        whole = self.template([*self.turns, (role, text)])
        rewrites = bool(self.turns) and not whole.startswith(self.shown)
        stays = len(commonprefix([self.shown, whole])) if rewrites else len(self.shown) if self.turns else 0
        dropped = len(self.shown) - stays if self.turns else 0
        piece = whole[stays:]
        start = self.length - dropped
        probe = self.template([*self.turns, (role, PROBE)])
        at = probe.find(PROBE, 0 if rewrites else stays)
        place = (None, None)
        if at >= 0 and not rewrites:
            tail = len(probe) - at - len(PROBE)
            if whole[:at] == probe[:at] and len(whole) - tail >= at and whole[len(whole) - tail :] == probe[len(probe) - tail :]:
                place = (start + at - stays, start + len(whole) - tail - stays)
        self.length = start + len(piece)
        self.turns.append((role, text))
        self.shown = whole
        return {"piece": piece, "dropped": dropped, "start": start, "text_start": place[0], "text_end": place[1], "rewrites": rewrites}


FORMATTED = "conv_id long, turn_no long, role string, piece string, dropped long, start long, text_start long, text_end long, loss boolean, rewrites boolean"


def renderer(template: Template, loss_roles: tuple[str, ...]):
    def run(batches):
        current, state, number = object(), None, 0
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            rows = []
            for conv, role, text in zip(ids, roles, texts):
                if conv != current or state is None:
                    current, state, number = conv, Renderer(template), 0
                r = state.add(role, text)
                r |= {"conv_id": conv, "turn_no": number, "role": role, "loss": role in loss_roles and r["text_start"] is not None}
                rows.append(r)
                number += 1
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("dropped", pa.int64()), ("start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])


def format_conversations(turns: DataFrame, template: Template = plain_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each turn of ``turns`` (conv_id, turn, role, text), in order within its conversation: the piece of
    output that it added, the characters of earlier output it took back (``dropped``, 0 unless ``rewrites``), where the
    piece starts in the conversation's output, where its text stands (null if the template rewrote or changed it so
    that it can't be placed), and whether it is under the loss mask.

    Turns go by turn, then role, then text, nulls first; null roles and texts are empty; rows with null conv_id are
    one conversation. One shuffle on conv_id and a sort within partitions. The template sees all turns so far, however
    many: its task holds the conversation, and the work grows with the square of its turns (plain_template joins turns
    that it has escaped before). Of equal turn numbers the order is that of role, then text; copies are turns of their own. An
    empty table gives no rows.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(renderer(template, loss_roles), FORMATTED)


def digester(reader):
    """Reads pieces back into turns and texts under the mask; holds two running digests."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        begun, current = False, None
        n = loss = chars = 0
        turns = masked = None
        for batch in batches:
            done = []
            ids, pieces, starts, ts, te, mask, rewrites = (batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "text_start", "text_end", "loss", "rewrites"))
            for i, conv in enumerate(ids):
                if not begun or conv != current:
                    if begun:
                        done.append({"conv_id": current, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss, "loss_sha256": masked.hexdigest(), "formatted_chars": chars})
                    begun, current, n, loss, chars = True, conv, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                if rewrites[i]:
                    raise ValueError("output that was rewritten can't be read turn by turn")
                for role, text, _, _ in reader(pieces[i]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if mask[i]:
                    text = unescape(pieces[i][ts[i] - starts[i] : te[i] - starts[i]])
                    loss += len(text)
                    masked.update(text.encode())
                chars = starts[i] + len(pieces[i])
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss, "loss_sha256": masked.hexdigest(), "formatted_chars": chars}], schema=schema)

    return run


# --------------------------------------------------------------------------- query


def op5_chat_format(spark, sf_dir, template: Template = plain_template):
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted output. A
    template that rewrites its output fails, as it can't be read back turn by turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    pieces = format_conversations(turns.unionByName(extra), template)
    # pieces stay where and as they are: what reads them back runs in the same tasks, in the same order
    return pieces.mapInArrow(digester(read_plain), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok', r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(regexp_replace(role, '[\\#<:]', '\\\0', 'g')) + length(regexp_replace(text, '[\\#<:]', '\\\0', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
