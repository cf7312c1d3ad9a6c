"""Operator 7, second half: format conversations with a compiled template and read them back.

Rows of one conversation are brought together and sorted by Spark's own
(spilling) sort; a task then walks over its rows and renders turn by turn, so
that it never holds more than one turn of a conversation.  The digests are
updated on the way.

Defined results: turns are in order of (turn, role, text), nulls first; null
roles and texts count as empty; repeated rows are turns of their own; rows with
a null conversation id form one conversation; extra columns are not read; an
empty table gives an empty table (the query still adds its conversation -1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal
from .chat_template import compile_template, unguard, unguard_line

BEGIN, END = "<|turn|>", "<|end|>\n"
TEMPLATE = (
    "{% for message in messages %}" + BEGIN + "{{ message.role | guard_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | guard }}{% endgeneration %}"
    "{% else %}{{ message.text | guard }}{% endif %}" + END + "{% endfor %}"
)
SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class Reader:
    """Reads formatted text as it comes and digests the turns and the masked text found in it."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.pending = ""
        self.masked: list[str] = []

    def feed(self, text: str, masked: bool) -> None:
        self.formatted_chars += len(text)
        self.pending += text
        if masked:
            self.masked.append(text)
        elif self.masked:
            self._close_mask()
        stop = self.pending.find(END)
        while stop >= 0:
            self._turn(self.pending[:stop])
            self.pending = self.pending[stop + len(END) :]
            stop = self.pending.find(END)

    def _close_mask(self) -> None:
        said = unguard("".join(self.masked))
        self.loss_chars += len(said)
        self.loss.update(said.encode())
        self.masked = []

    def _turn(self, turn: str) -> None:
        if not turn.startswith(BEGIN):
            raise ValueError("a turn does not begin with its mark")
        role, _, text = turn[len(BEGIN) :].partition("\n")
        self.n_turns += 1
        self.turns.update(f"{unguard_line(role)}\n{unguard(text)}\n".encode())

    def row(self, conv_id: int | None) -> tuple:
        if self.masked:
            self._close_mask()
        if self.pending:
            raise ValueError("the last turn is not closed")
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    picked = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(id, its turns), one after the other; the turns must be used up before the next is asked for."""
    rows = ((c, {"turn": t, "role": r or "", "text": x or ""}) for b in batches for c, t, r, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
    row = next(rows, None)

    while row is not None:
        conv_id = row[0]

        def turns(conv_id: int | None = conv_id) -> Iterator[dict]:
            nonlocal row
            while row is not None and row[0] == conv_id:
                yield row[1]
                row = next(rows, None)

        mine = turns()
        yield conv_id, mine
        for _ in mine:
            pass


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row (``SCHEMA``) for each conversation, read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
        fmt, out = compile_template(template), []

        def packed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for conv_id, turns in _conversations(batches):
            reader = Reader()
            for text, masked in fmt(messages=turns):
                reader.feed(text, masked)
            out.append(reader.row(conv_id))
            if len(out) >= 4096:
                yield packed()
                out = []
        if out:
            yield packed()

    return _sorted_turns(conversations).mapInArrow(frugal(run), SCHEMA)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, text, loss_spans): each conversation as one training text with its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt = compile_template(template)
        for conv_id, turns in _conversations(batches):
            pieces, spans, at = [], [], 0
            for text, masked in fmt(messages=turns):
                pieces.append(text)
                if masked:
                    spans.append({"start": at, "stop": at + len(text)})
                at += len(text)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array(["".join(pieces)], pa.string()), pa.array([spans], kind)], ["conv_id", "text", "loss_spans"])

    return _sorted_turns(conversations).mapInArrow(frugal(run), "conv_id bigint, text string, loss_spans array<struct<start:bigint,stop:bigint>>")


#: DuckDB SQL for ``digests`` over ``conversations`` and conversation -1.
ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|turn|>') + 1 + length('<|end|>') + 1
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::bigint as formatted_chars
from turns group by conv_id
"""
