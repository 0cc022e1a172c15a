"""Chat formatting that is checked by reading it back.

Grammar (deterministic, one turn after another)::

    conversation = turn*
    turn         = "<s>[" TAG "] " body " [/" TAG "]</s>"
    TAG          = "INST" (user) | "ANS" (assistant) | "SYS" (system) | "ROLE:" name (any other role, %XX-coded)

The control strings are ``CONTROL``. The lexer splits a rendered turn into control strings and literal text; the
parser accepts only opening, literal, closing. A turn is rendered as it is, parsed, and compared with its source. If
they differ, its content is escaped one backslash deeper and the turn is parsed again, until both are identical:
``</s>`` becomes ``<\\/s>``, and a text that already says ``<\\/s>`` becomes ``<\\\\/s>``. Reading takes one backslash
away, so the coding is reversible for every text. The loss mask is the body of each assistant turn.

Defined cases: a null text is empty, a null role is the empty role; turns are ordered by turn (nulls first), then
role and text, so ties and repeated rows have one order; rows with a null conversation id are one conversation; an
empty table gives no row. A conversation is streamed turn by turn in order, so its length is not bounded by memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import per_batch, text_of

TAGS = {"user": "INST", "assistant": "ANS", "system": "SYS"}
ROLES = {v: k for k, v in TAGS.items()}
#: A control string without the backslashes that escaping puts behind its first character.
CONTROL = r"<(?:/?s)>|\[(?:/?(?:INST|ANS|SYS))\]|\[/?ROLE:[^\]\s]*\]"
_LEX = re.compile(CONTROL)
_ESCAPE = re.compile(r"([<\[])(\\*)(?=/?s>|/?(?:INST|ANS|SYS)\]|/?ROLE:[^\]\s]*\])")
TURN_SCHEMA = "conv_id long, turn long, role string, text string, segment string, loss_from long, loss_to long"
SPAN_TEXT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2" + "\\\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2][1:], text)


def tag_of(role: str) -> str:
    return TAGS.get(role) or "ROLE:" + quote(role, safe="")


def role_of(tag: str) -> str | None:
    return unquote(tag[5:]) if tag.startswith("ROLE:") else ROLES.get(tag)


def parse_turn(segment: str) -> tuple[str, str, int, int] | None:
    """Role, text, and the body's place in one rendered turn; None if the grammar doesn't accept it."""
    marks = list(_LEX.finditer(segment))
    if len(marks) != 4 or [marks[0][0], marks[3][0]] != ["<s>", "</s>"] or marks[0].start() or marks[3].end() != len(segment):
        return None
    tag = marks[1][0][1:-1]
    role, start, end = role_of(tag), marks[1].end() + 1, marks[2].start() - 1
    if role is None or marks[2][0] != f"[/{tag}]" or start > end or marks[1].start() != 3 or marks[2].end() != marks[3].start():
        return None
    if segment[start - 1] != " " or segment[end] != " ":
        return None
    return role, unescape(segment[start:end]), start, end


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendered text and the place of its body, escaped until it reads back as its source."""
    tag, body = tag_of(role), text
    while True:
        segment = f"<s>[{tag}] {body} [/{tag}]</s>"
        found = parse_turn(segment)
        if found and found[:2] == (role, text):
            return segment, found[2], found[3]
        if len(body) > 2 * len(text) + 64:
            raise ValueError("escaping does not end")  # not reached: one pass makes any text literal
        body = escape(body)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: its source, its rendered segment and the loss mask as [loss_from, loss_to) in the segment."""
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), text_of(text_col).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        made = [render_turn(r, t) for r, t in zip(roles, texts)]
        masks = [(a, b) if r == "assistant" else (None, None) for r, (_, a, b) in zip(roles, made)]
        extra = [pa.array([s for s, _, _ in made], pa.string()), pa.array([a for a, _ in masks], pa.int64()), pa.array([b for _, b in masks], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["conv_id", "turn", "role", "text", "segment", "loss_from", "loss_to"])

    return rows.mapInArrow(per_batch(run, 2048), TURN_SCHEMA)


class Reader:
    """Reads one conversation back, segment by segment, into running digests."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss_from, loss_to) -> None:
        role, text, _, _ = parse_turn(segment)
        self.turns, self.chars = self.turns + 1, self.chars + len(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        if loss_from is not None:
            seen = unescape(segment[loss_from:loss_to])
            self.loss += len(seen)
            self.masked.update(seen.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted output says, by conversation. Rendering is done before the shuffle; here a task only reads."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment", "loss_from", "loss_to")
    names = [x.split()[0] for x in SPAN_TEXT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for conv_id, segment, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = Reader(conv_id)
                now.add(segment, a, b)
            if len(rows) > 5000:
                yield pack(rows)
                rows = []
        if now is not None:
            yield pack([*rows, now.row()])

    return ordered.mapInArrow(task, SPAN_TEXT)
