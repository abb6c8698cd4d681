"""Operator 12, repair of the structure of conversations by a Viterbi search with survivor coalescence.

A conversation should have the role initials ``(s?(ua)+)?``. Edits of a row: keep (K, 0), give it the role
user or assistant (R, 1), delete it (D, 2); a user or assistant row without text may be inserted anywhere
(I, 5). Blank and duplicate rows must be deleted, a truncated row that stays costs 5 more. The cheapest
edits win; among equals the smallest string of edits.

Four states (nothing yet, after system, after user, after assistant) each keep one survivor. Survivors are
leaves of a tree of backpointers: a node holds the edits since its parent and counts its children. A leaf
without successor is removed, a node with one child left is joined to it, so the tree has at most seven
nodes with one byte per edit. As soon as all survivors share an ancestor its edits are given out. A
survivor that another one beats in any future, whatever has to be inserted, is dropped at once. Two
survivors of equal cost are compared by their complete unresolved edits: their order is carried from row
to row, since an order of whole strings only changes by what is appended. Inserts stand before the next
row's edit, so of two survivors none is the beginning of the other.

Two passes. The first sees no texts: rows of conversations are sorted by turn, and pieces of edits and a
summary leave the task. In the second the pieces meet the texts, sorted in front of the rows that they
are for. Rows go through both as a stream: no conversation is held in a task. Repeated texts are found
before, by one aggregation over hashes of conversation, role and text; a first turn exists only for texts
that repeat, and that table is measured before it is broadcast.

Defined cases: null roles and texts are one space, a null turn comes first, a null id is a conversation.
Rows of one turn are ordered by role, then by hash of role and text. Equal rows are duplicates. A role
counts by its first character, whatever follows; an empty role has none. A conversation of which
all rows are marked absent is in the summary with zeros and has no edits. An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.batches import bound_batches
from sensorloom.operators.lookup import join_lookup
from sensorloom.session import materialise

WHITE = "\\u0009\\u000a\\u000b\\u000c\\u000d\\u0020"
START, SYSTEM, USER, ASSISTANT = range(4)
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# (state, cost, edits) that inserts lead to.
REACH = [
    [(START, 0, ""), (USER, INSERT, "I"), (ASSISTANT, 2 * INSERT, "II")],
    [(SYSTEM, 0, ""), (USER, INSERT, "I"), (ASSISTANT, 2 * INSERT, "II")],
    [(USER, 0, ""), (ASSISTANT, INSERT, "I")],
    [(ASSISTANT, 0, ""), (USER, INSERT, "I")],
]
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
RETAGGED = [USER, USER, ASSISTANT, USER]
# BRIDGE[x][y]: what x pays at most to do all that y can still do, and end as y does.
# Nothing yet -> done is free for an assistant's end; a system row that only y may keep costs a deletion.
BRIDGE = [
    [0, 0, INSERT, 2 * INSERT],
    [2 * INSERT, 0, INSERT, 2 * INSERT],
    [INSERT + DELETE, INSERT, 0, INSERT],
    [DELETE, 0, INSERT, 0],
]
LAST = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
LEGAL = {"su", "ua", "au"}
PIECE = 4096  # edits in a piece


class Node:
    """Edits since the parent; ``kids`` are the nodes that refer to this one."""

    __slots__ = ("parent", "edits", "kids")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.kids = parent, bytearray(edits, "ascii"), []


class Search:
    """Cheapest edits of one conversation, row by row; ``resolved`` collects the edits that are settled."""

    def __init__(self) -> None:
        self.root = Node(None, "")
        self.survivors: list[tuple[int, int, Node]] = [(START, 0, self.root)]  # in the order of their edits
        self.resolved = bytearray()

    def row(self, initial: str, forced: bool, truncated: bool) -> None:
        offers: dict[int, tuple[int, int, str]] = {}

        def offer(state: int, cost: int, order: int, edits: str) -> None:
            if state not in offers or (cost, order, edits) < offers[state]:
                offers[state] = (cost, order, edits)

        more = TRUNCATED if truncated else 0
        for order, (state, cost, _) in enumerate(self.survivors):
            for at, price, inserted in REACH[state]:
                total = cost + price
                offer(at, total + DELETE, order, inserted + "D")
                if not forced:
                    if (to := KEPT[at].get(initial)) is not None:
                        offer(to, total + more, order, inserted + "K")
                    offer(RETAGGED[at], total + RETAG + more, order, inserted + "R")
        going = [
            (order, edits, y, cost) for y, (cost, order, edits) in offers.items()
            if not any(offers[x][0] + BRIDGE[x][y] < cost for x in offers)]
        self.grow(sorted(going))

    def grow(self, going: list[tuple[int, str, int, int]]) -> None:
        """Puts the new survivors below the old ones, then removes and joins what is left over."""
        heirs: dict[int, list] = {}
        for order, edits, state, cost in going:
            heirs.setdefault(order, []).append((edits, state, cost))
        old, self.survivors = self.survivors, []
        for order, (_, _, leaf) in enumerate(old):
            mine = heirs.get(order, [])
            if len(mine) == 1:
                edits, state, cost = mine[0]
                leaf.edits += edits.encode("ascii")
                self.survivors.append((state, cost, leaf))
            else:
                for edits, state, cost in mine:
                    kid = Node(leaf, edits)
                    leaf.kids.append(kid)
                    self.survivors.append((state, cost, kid))
        for order, (_, _, leaf) in enumerate(old):
            if order not in heirs:
                self.remove(leaf)
        while True:  # what all survivors share is settled
            self.resolved += self.root.edits
            self.root.edits.clear()
            if len(self.root.kids) != 1:
                break
            self.root = self.root.kids[0]
            self.root.parent = None

    def remove(self, leaf: Node) -> None:
        parent = leaf.parent
        if parent is None:
            return
        parent.kids.remove(leaf)
        if len(parent.kids) == 1 and parent.parent is not None:
            only, above = parent.kids[0], parent.parent
            only.edits[:0] = parent.edits
            only.parent = above
            above.kids[above.kids.index(parent)] = only

    def end(self) -> int:
        """Settles the rest; the cost."""
        cost, order, edits = min((cost + LAST[state][0], order, LAST[state][1]) for order, (state, cost, _) in enumerate(self.survivors))
        node, path = self.survivors[order][2], []
        while node is not None:
            path.append(bytes(node.edits))
            node = node.parent
        self.resolved += b"".join(reversed(path)) + edits.encode("ascii")
        return cost


class Conversation:
    """One conversation in the first pass: its search, its faults, where its pieces belong."""

    COUNTS = ("blank", "duplicate", "truncated")

    def __init__(self, name):
        self.name, self.search = name, Search()
        self.rows = self.done = self.pieces = self.illegal = self.turns = 0
        self.faults = dict.fromkeys(self.COUNTS, 0)
        self.low = self.high = self.initial = None
        self.last: tuple = (None, None)
        self.marks: deque = deque()  # (row number, place) of every PIECE-th row that is not settled

    def row(self, turn, role: str, key: bytes, initial: str, blank: bool, later: bool, truncated: bool) -> None:
        again = later or (key == self.last[1] and turn == self.last[0])
        fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
        if fault:
            self.faults[fault] += 1
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.last, self.initial = (turn, key), initial
        if self.rows % PIECE == 0:
            self.marks.append((self.rows, (turn, role, key)))
        self.rows += 1
        self.search.row(initial, blank or again, fault == "truncated")

    def piece(self) -> tuple:
        """The settled edits as a row of the table of pieces."""
        edits = bytes(self.search.resolved)
        self.search.resolved.clear()
        while len(self.marks) > 1 and self.marks[1][0] <= self.done:
            self.marks.popleft()
        place = self.marks[0][1] if self.marks else (None, "", b"")
        self.done += len(edits) - edits.count(b"I")
        self.pieces += 1
        return (self.name, *place, self.pieces, edits.decode("ascii"))

    def last_piece(self) -> tuple:
        cost = self.search.end() if self.rows else 0
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (*self.piece(), gaps, *self.faults.values(), int(self.illegal), cost)


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def streamed(rows: Iterator[tuple], names: list[str], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Record batches of a stream of rows, bounded in rows and in characters."""
    held, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*held))], names)

    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight > 1 << 20:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def prepared(df: DataFrame, conv: str, turn: str, role: str, text: str, absent: str | None) -> DataFrame:
    """Rows under inner names; ``key`` tells conversation, role and text."""
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.col(f"`{absent}`") if absent else F.lit(False)).alias("absent"))
    name = "IF(conv IS NULL, '-', concat('=', length(CAST(conv AS STRING)), ':', CAST(conv AS STRING)))"
    return rows.withColumn("key", F.expr(f"unhex(sha2(concat({name}, ':', length(role), ':', role, text), 256))"))


def marked(rows: DataFrame) -> DataFrame:
    """The first pass's rows: initials and faults instead of texts."""
    # Nulls first, as in the order of the rows.
    first = rows.filter("NOT absent").groupBy("key").agg(F.expr("min(struct(turn IS NOT NULL AS known, turn)) AS first"), F.expr("count(*) AS n"))
    repeated = first.filter("n > 1").select("key", "first")
    narrow = rows.withColumn("rest", F.expr(f"rtrim('{WHITE}', text)")).selectExpr(
        "conv", "turn", "IF(absent, '', role) AS role", "key", "absent", "substring(role, 1, 1) AS initial", "rest = '' AS blank",
        "right(rest, 1) NOT IN ('.', '!', '?') AS truncated")
    joined = join_lookup(narrow, repeated, ["key"], how="left")
    return joined.selectExpr("conv", "turn", "role", "key", "absent", "initial", "blank", "truncated",
                             "coalesce(struct(turn IS NOT NULL AS known, turn) > first, false) AS later")


def edit_pieces(rows: DataFrame) -> DataFrame:
    """First pass: stored table of pieces (conv, place, number, edits), with the summary on a conversation's last one."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "turn", "role", "key", "number", "edits", *SUMMARY]
    columns = f"conv {kind}, turn long, role string, key binary, number long, edits string, " + ", ".join(f"{c} long" for c in SUMMARY)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: Conversation | None = None
        for batch in batches:
            for conv, turn, role, key, absent, initial, blank, truncated, later in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.name != conv:
                    if now is not None:
                        yield now.last_piece()
                    now = Conversation(conv)
                if absent:
                    continue
                now.row(turn, role, key, initial, blank, later, truncated)
                if len(now.search.resolved) >= PIECE:
                    yield (*now.piece(), *[None] * len(SUMMARY))
        if now is not None:
            yield now.last_piece()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field(0).type), ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()),
                            ("number", pa.int64()), ("edits", pa.string()), *((c, pa.int64()) for c in SUMMARY)])
        yield from streamed(settled(chain_first(first, batches)), names, schema)

    placed = marked(rows).repartition("conv").sortWithinPartitions("conv", "turn", "role", "key")
    return materialise(placed.mapInArrow(run, columns))


def chain_first(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Second pass over pieces and rows: (conv, position, edit, role, text) per edit."""
    none = object()
    now, waiting, at, position, turns = none, deque(), 0, 0, 0

    def edit(role, text) -> Iterator[tuple]:
        """Edits up to and with the next one of a row; without a row, the inserts that are left."""
        nonlocal at, position, turns
        while waiting:
            if at == len(waiting[0]):
                waiting.popleft()
                at = 0
                continue
            letter = waiting[0][at]
            if role is None and letter != "I":
                raise ValueError(f"conversation {now}: edits without rows")
            at, position = at + 1, position + 1
            if letter == "D":
                yield (now, position, letter, role, text)
            else:
                # The first row may be a system row; from then on user and assistant take turns.
                turns += not (letter == "K" and turns == 0 and role[:1] == "s")
                name = role if letter == "K" else "user" if turns % 2 else "assistant"
                yield (now, position, letter, name, "" if letter == "I" else text)
            if letter != "I":
                return
        if role is not None:
            raise ValueError(f"conversation {now}: rows without edits")

    for batch in batches:
        for conv, kind, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "edits", "role", "text"))):
            if now is none or conv != now:
                yield from edit(None, None)
                now, at, position, turns = conv, 0, 0, 0
                waiting.clear()
            if kind == 0:
                waiting.append(edits)
            else:
                yield from edit(role, text)
    yield from edit(None, None)


EDITS = ["conv", "position", "edit", "role", "text"]


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(edits, summary). Edits: conv, position, edit, role, text, in order inside a partition that holds the whole conversation;
    kept and new rows with their final role, deleted ones as they were. Summary: one row per conversation.

    ``absent``: a column that is true for rows which only name their conversation.
    """
    bound_batches(df.sparkSession)
    rows = prepared(df, conv, turn, role, text, absent)
    pieces = edit_pieces(rows)
    both = rows.filter("NOT absent").selectExpr("conv", "turn", "role", "key", "1 AS kind", "0L AS number", "CAST(NULL AS STRING) AS edits", "text").unionByName(
        pieces.selectExpr("conv", "turn", "role", "key", "0 AS kind", "number", "edits", "CAST(NULL AS STRING) AS text"))
    placed = both.repartition("conv").sortWithinPartitions("conv", "turn", "role", "key", "kind", "number")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field("conv").type), ("position", pa.int64()), *((c, pa.string()) for c in EDITS[2:])])
        yield from streamed(edited_rows(chain_first(first, batches)), EDITS, schema)

    edits = placed.mapInArrow(run, f"conv {kind}, position long, edit string, role string, text string")
    return edits, pieces.filter("gaps IS NOT NULL").select("conv", *SUMMARY)


def repair_digests(edits: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256 of each conversation that has edits; reads its rows as a stream, so the hash needs no whole text."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        none = object()
        now, audit, seen, filled = none, bytearray(), hashlib.sha256(), False
        for batch in batches:
            for conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "role", "text"))):
                if now is none or conv != now:
                    if now is not none:
                        yield (now, audit.decode("ascii"), seen.hexdigest())
                    now, audit, seen, filled = conv, bytearray(), hashlib.sha256(), False
                audit += edit.encode("ascii")
                if edit != "D":
                    seen.update(f"{chr(10) if filled else ''}{role}:{text}".encode("utf-8"))
                    filled = True
        if now is not none:
            yield (now, audit.decode("ascii"), seen.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field("conv").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from streamed(digests(chain_first(first, batches)), schema.names, schema)

    return edits.mapInArrow(run, f"conv {edits.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string")
