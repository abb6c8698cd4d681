"""Operator 13, chat formatting with compiled templates.

A template (``templates``) is compiled once per task and renders the rows of a conversation, sorted by turn, as
a stream. The formatted text leaves the task in parts of bounded length with the spans of its generation
blocks, so no conversation is held. ``read_back`` takes the parts of the default template apart again: turns
between their marks, and the text under the loss mask, both unescaped.

Control strings inside texts are escaped reversibly: every ``<``, backslashes, ``|`` gets one more backslash, so
that no ``<|`` is left. Roles are also brought to one line.

Defined cases: null roles and texts are empty, a null turn comes first, a null id is a conversation. Rows of one
turn are ordered by role, then text; repeated rows are turns of their own. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.batches import bound_batches
from sensorloom.llm.templates import compile_template, lines_back, unescape

BEGIN, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}" + BEGIN + "{{ message.role | one_line | escape }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}" + END + "\n{% endfor %}")
PART = 1 << 20  # characters after which a part ends


@lru_cache(maxsize=16)
def compiled(template: str):
    return compile_template(template)


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its messages as a stream); a stream must be read to its end before the next conversation."""
    rows = ((conv, role, text) for b in batches for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text"))))
    held = next(rows, None)

    def messages(name) -> Iterator[dict]:
        nonlocal held
        while held is not None and held[0] == name:
            now, held = held, None
            yield {"role": now[1], "text": now[2]}
            held = next(rows, None)

    while held is not None:
        name = held[0]
        stream = messages(name)
        yield name, stream
        for _ in stream:  # a template need not read all
            pass


def parts_of(pieces: Iterator[tuple[str, bool]], limit: int) -> Iterator[tuple[str, list[dict]]]:
    """(text, spans under the mask) of at most a little more than ``limit`` characters."""
    held, length, spans = [], 0, []
    for text, marked in pieces:
        if not text:
            continue
        if marked:
            spans.append({"start": length, "end": length + len(text)})
        held.append(text)
        length += len(text)
        if length >= limit:
            yield "".join(held), spans
            held, length, spans = [], 0, []
    if held or length == 0:
        yield "".join(held), spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(
    df: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART,
) -> DataFrame:
    """conv, part, formatted, spans (start, end in characters of the part); the parts of a conversation follow each other in one partition.

    The last part may be empty. The template sees ``messages``, a stream of mappings with role and text.
    """
    compiled(template)  # errors show here, not in a task
    bound_batches(df.sparkSession)
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    placed = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, held, weight, conv_type = compiled(template), [], 0, None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), SPANS]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], ["conv", "part", "formatted", "spans"])

        for name, messages in conversations_of(seen()):
            for number, (formatted, spans) in enumerate(parts_of(render({"messages": messages}), part)):
                held.append((name, number, formatted, spans))
                weight += len(formatted)
                if weight >= PART or len(held) >= 1000:
                    yield batch()
                    held, weight = [], 0
        if held:
            yield batch()

    return placed.mapInArrow(run, f"conv {kind}, part long, formatted string, spans array<struct<start: long, end: long>>")


class Reader:
    """Takes one formatted conversation apart, part by part."""

    def __init__(self, name):
        self.name, self.rest, self.open_span = name, "", ""
        self.turns = self.loss_chars = self.chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.begun = False  # whether the header of the turn in ``rest`` has been read

    def add(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for span in spans:
            self.loss(formatted[span["start"]:span["end"]])
        self.rest += formatted
        at = 0
        while (end := self.rest.find(END + "\n", at)) >= 0:
            header, _, text = self.rest[at:end].partition("\n")
            if not header.startswith(BEGIN):
                raise ValueError(f"conversation {self.name}: a turn without its mark")
            self.turns += 1
            role = lines_back(unescape(header[len(BEGIN):]))
            self.turn_hash.update(f"{role}\n{unescape(text)}\n".encode("utf-8"))
            at = end + len(END) + 1
        self.rest = self.rest[at:]

    def loss(self, escaped: str) -> None:
        text = unescape(escaped)
        self.loss_chars += len(text)
        self.loss_hash.update(text.encode("utf-8"))

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.name}: a turn without its end")
        return (self.name, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars)


READ = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the turns and the text under the mask, read from the parts of the default template.

    Takes the parts as ``format_conversations`` leaves them: those of a conversation in order in one partition. A span
    never crosses a part, because a part ends between two pieces.
    """
    kind = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reader | None = None
        for batch in batches:
            done = []
            for conv, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "formatted", "spans"))):
                if part == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Reader(conv)
                now.add(text, spans)
            if done:
                yield rows(done, batch.schema.field("conv").type)
        if now is not None:
            yield rows([now.row()], batch.schema.field("conv").type)

    def rows(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], READ)

    return formatted.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
