"""Conversations formatted by a compiled template, and read back from what was written.

Rows are dealt by conversation and sorted by turn, then streamed: a conversation of any length passes
through a task message by message, and its formatted text leaves in chunks of bounded size with the
spans that a model is to learn. What a conversation's hash or its later turns need is the work of
one task by nature; everything else is spread.

Defined results: null roles and texts are empty; rows without a conversation form one conversation
without an id; null turns come first; equal turns are ordered by role and text, so repeated rows are
repeated turns; a conversation is never empty; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches, rows_of
from verdigris.llm.templates import Sink, Template, messages_of, unescape

#: Turns are marked by lines in angle brackets; in texts and roles these are escaped.
TURNS = (
    "{% for message in messages %}<turn {{ message.role|escape }}>\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text|escape }}{% endgeneration %}"
    "{% else %}{{ message.text|escape }}{% endif %}\n</turn>\n{% endfor %}"
    "{% if add_generation_prompt %}<turn assistant>\n{% endif %}"
)
#: Characters of a chunk, unless one message has more.
CHUNK = 1 << 20
_TURN = re.compile(r"<turn ([^<>]*)>\n([^<]*)\n</turn>\n")


class _Chunks(Sink):
    """Gathers output; learned spans are relative to the chunk, each piece of generation its own."""

    def __init__(self):
        self.pieces: list[str] = []
        self.spans: list[int] = []
        self.at = 0

    def write(self, piece, learned):
        if learned:
            self.spans += [self.at, self.at + len(piece)]
        self.pieces.append(piece)
        self.at += len(piece)

    def take(self) -> tuple[str, list[int]]:
        out = "".join(self.pieces), self.spans
        self.pieces, self.spans, self.at = [], [], 0
        return out


def chunks(template: Template, rows: Iterator[tuple[str | None, str | None]], add_generation_prompt: bool = False, size: int = CHUNK) -> Iterator[tuple[str, list[int]]]:
    """The formatted conversation in chunks that end between messages, as its rows come in."""
    sink = _Chunks()
    for _ in template.steps(sink, messages=messages_of(rows), add_generation_prompt=add_generation_prompt):
        if sink.at >= size:
            yield sink.take()
    if sink.pieces:
        yield sink.take()


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation side by side, in order of their turns."""
    narrow = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return narrow.repartition("conv_id").sortWithinPartitions(*keys)


def render(conversations: DataFrame, source: str = TURNS, add_generation_prompt: bool = False) -> DataFrame:
    """One row per chunk: conv_id, chunk, formatted, learned (starts and ends in code points)."""

    def work(batches):
        template = Template(source)
        for conv, rows in groupby(rows_of(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            for k, (formatted, learned) in enumerate(chunks(template, ((r, t) for _, r, t in rows), add_generation_prompt)):
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([k], pa.int64()), pa.array([formatted]), pa.array([learned], pa.list_(pa.int64()))], ["conv_id", "chunk", "formatted", "learned"])

    return map_batches(ordered(conversations), work, "conv_id bigint, chunk bigint, formatted string, learned array<bigint>")


class Reader:
    """Reads a formatted conversation chunk by chunk."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, learned: list[int]) -> None:
        at = 0
        for m in _TURN.finditer(formatted):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            self.turns += 1
            self.said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        if at != len(formatted):
            raise ValueError("an open turn")
        for a, b in zip(learned[::2], learned[1::2], strict=True):
            text = unescape(formatted[a:b])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)


def read_back(conversations: DataFrame) -> DataFrame:
    """Formats every conversation and returns what reading the output gives."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches):
        template, out = Template(TURNS), []

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for conv, rows in groupby(rows_of(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            reader = Reader()
            for formatted, learned in chunks(template, ((r, t) for _, r, t in rows)):
                reader.read(formatted, learned)
            out.append((conv, reader.turns, reader.said.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) == 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return map_batches(ordered(conversations), work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
