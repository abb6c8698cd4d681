"""Operator 2, line dedup by sorted ranges of line hashes and per-document keep bitmaps.

Every line becomes (128-bit hash of its key, document, position). The rows are range-partitioned by
hash and document and sorted, so one pass over a partition sees all occurrences of a key in order,
and a key that occurs everywhere spreads over several partitions. A run of equal hashes that begins
or ends with the partition leaves a summary; summaries of one hash are added up and decide the few
rows that were left open. What comes back to the documents is one compressed bitmap per document, not
text.

Rows are documents. Rows with the same id and text share one bitmap, so they go through as one row that counts
as many times as it stands in the table.

Defined cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars``
stay; of rows with the same id and text, ``keep_first`` keeps or drops the lines alike; a null id is an id like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.batches import bound_batches, map_texts, slices
from sensorloom.session import materialise

MIN_DOCS = 10
LINE_COLUMNS = "h1 long, h2 long, doc {id}, text_hash long, copies long, pos int"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """Key per line: ASCII white space stripped, A-Z lowered; None if too short."""
    keys = [line.strip().lower() for line in text.split(b"\n")]  # of bytes: ASCII only
    if min_chars <= 1:
        return [k or None for k in keys]
    return [k if len(k.decode("utf-8")) >= min_chars else None for k in keys]


def line_rows(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """h1, h2, doc, text_hash, copies, pos per line that has a key."""
    bound_batches(docs.sparkSession)
    source = docs.select(
        F.col(f"`{id_column}`").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("text_hash"),
        F.encode(F.coalesce(F.col(f"`{text_column}`"), F.lit("")), "UTF-8").alias("text"))
    counted = source.groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    if counted.filter("copies > 1").isEmpty():
        source = source.withColumn("copies", F.lit(1).cast("long"))
    else:
        # Combined before the shuffle, so that a row that makes up much of the table is one row per task.
        source = source.groupBy("doc", "text_hash").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in slices(texts):
                digests, rows, places = [], [], []
                for i in range(start, end):
                    for pos, key in enumerate(line_keys(texts[i], min_chars)):
                        if key is not None:
                            digests.append(xxhash.xxh3_128_digest(key))
                            rows.append(i)
                            places.append(pos)
                halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(batch.column(c).take(at) for c in (0, 1, 3)), pa.array(places, pa.int32())],
                    ["h1", "h2", "doc", "text_hash", "copies", "pos"])

    return source.mapInArrow(run, LINE_COLUMNS.format(id=source.schema["doc"].dataType.simpleString()))


class Runs:
    """One pass over the sorted rows of a partition.

    kind 0: this line goes. kind 1: undecided row of a run at an edge. kind 2: summary of such a run,
    with the number of documents in ``n`` and its first row.
    """

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.first_run = True
        self.held: pa.Table | None = None  # rows of the open run that are not decided yet
        self.flushed = 0  # documents of the open run whose rows have been given out
        self.flushed_first: pa.Table | None = None
        self.last_doc: tuple | None = None

    @staticmethod
    def changes(table: pa.Table, names: list[str]) -> np.ndarray:
        """True where a row differs from the one before in any of the columns."""
        n = len(table)
        out = np.zeros(n, bool)
        for name in names:
            column = table.column(name).combine_chunks()
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if name == "doc" else column.to_numpy()
            out[1:] |= codes[1:] != codes[:-1]
        return out

    def out(self, table: pa.Table, kind: int, n: int = 0) -> pa.Table:
        size = len(table)
        return table.append_column("kind", pa.array(np.full(size, kind, np.int32))).append_column("n", pa.array(np.full(size, n, np.int64)))

    def add(self, table: pa.Table) -> Iterator[pa.Table]:
        if self.held is not None:
            table = pa.concat_tables([self.held, table]).combine_chunks()
            self.held = None
        new_run = self.changes(table, ["h1", "h2"])
        starts = np.concatenate(([0], np.flatnonzero(new_run)))
        last = starts[-1]
        closed = table.slice(0, last)
        if len(closed):
            yield from self.closed_runs(closed, new_run[:last])
        self.held = table.slice(last)
        yield from self.flush_open()

    def flush_open(self) -> Iterator[pa.Table]:
        """Gives out the rows of an open run that is surely frequent, so that it needs no memory."""
        docs = self.n_docs(self.held)
        if self.flushed + docs < self.min_docs or len(self.held) < 2:
            return
        if not self.flushed:
            self.flushed_first = self.held.slice(0, 1)
        ready, rest = self.held.slice(0, len(self.held) - 1), self.held.slice(len(self.held) - 1)
        new = self.n_docs(ready)
        yield self.out(ready.slice(1) if not self.flushed else ready, 0)
        self.flushed += new
        self.last_doc = self.doc_of(ready, len(ready) - 1)
        self.held = rest

    def doc_of(self, table: pa.Table, i: int) -> tuple:
        return tuple(table.column(c)[i].as_py() for c in ("doc", "text_hash"))

    def n_docs(self, table: pa.Table) -> int:
        """Documents in rows of one run, less one if the first has been counted."""
        if not len(table):
            return 0
        new = self.changes(table, ["doc", "text_hash"])
        new[0] = not self.flushed or self.doc_of(table, 0) != self.last_doc
        return int(table.column("copies").to_numpy()[new].sum())

    def decide_first(self, first: pa.Table, docs: int, edge: bool) -> Iterator[pa.Table]:
        if edge:
            yield self.out(first, 1)
            yield self.out(first, 2, docs)
        elif not self.keep_first:
            yield self.out(first, 0)

    def closed_runs(self, table: pa.Table, new_run: np.ndarray) -> Iterator[pa.Table]:
        """Complete runs; the first of them may continue an open one or the previous partition."""
        starts = np.concatenate(([0], np.flatnonzero(new_run)))
        at = 0
        if self.flushed or self.first_run:
            end = starts[1] if len(starts) > 1 else len(table)
            yield from self.end_run(table.slice(0, end), edge=self.first_run)
            at = end
        table, new_run = table.slice(at), new_run[at:]
        if not len(table):
            return
        new_run = new_run.copy()
        new_run[0] = True
        run = np.cumsum(new_run) - 1
        new_doc = self.changes(table, ["doc", "text_hash"]) | new_run
        docs = np.bincount(run, weights=new_doc * table.column("copies").to_numpy()).astype(np.int64)
        gone = docs[run] >= self.min_docs
        if self.keep_first:
            gone &= ~new_run
        if gone.any():
            yield self.out(table.filter(pa.array(gone)), 0)

    def end_run(self, rows: pa.Table, edge: bool) -> Iterator[pa.Table]:
        """Ends one run given by the rows that have not been given out yet."""
        docs = self.flushed + self.n_docs(rows)
        if self.flushed:
            yield self.out(rows, 0)
            yield from self.decide_first(self.flushed_first, docs, edge)
        elif edge:
            yield self.out(rows, 1)
            yield self.out(rows.slice(0, 1), 2, docs)
        elif docs >= self.min_docs:
            yield self.out(rows.slice(1) if self.keep_first else rows, 0)
        self.flushed, self.flushed_first, self.last_doc, self.first_run = 0, None, None, False

    def finish(self) -> Iterator[pa.Table]:
        if self.held is not None:
            yield from self.end_run(self.held, edge=True)


def stream_runs(sorted_lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_lines.schema.fields) + ", kind int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(min_docs, keep_first)
        for batch in batches:
            if batch.num_rows:
                for table in runs.add(pa.Table.from_batches([batch])):
                    yield from table.combine_chunks().to_batches()
        for table in runs.finish():
            yield from table.combine_chunks().to_batches()

    return sorted_lines.mapInArrow(run, schema)


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc, text_hash, pos) of the lines to drop.

    A key in at least ``min_docs`` documents loses its lines: all of them, or all but the first by
    document and position with ``keep_first`` (``min_docs=1`` then removes every later repetition).
    """
    # Stored, because finding the ranges reads the lines a second time.
    ordered = materialise(lines).repartitionByRange("h1", "h2", "doc", "text_hash").sortWithinPartitions("h1", "h2", "doc", "text_hash", "pos")
    seen = materialise(stream_runs(ordered, min_docs, keep_first))
    whole = materialise(
        seen.filter("kind = 2").groupBy("h1", "h2")
        .agg(F.sum("n").alias("docs"), F.min(F.struct("doc", "text_hash", "pos")).alias("first"))
        .filter(F.col("docs") >= min_docs))
    open_rows = seen.filter("kind = 1").join(whole, ["h1", "h2"])
    if keep_first:
        open_rows = open_rows.filter(~F.struct("doc", "text_hash", "pos").eqNullSafe(F.col("first")))
    names = ["doc", "text_hash", "pos"]
    return seen.filter("kind = 0").select(*names).unionByName(open_rows.select(*names))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, text_hash, bitmap): deflated bits, 1 = the line stays; lines beyond the last bit stay."""
    per_document = dropped.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone"))
    id_type = dropped.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = []
            for gone in batch.column(2):
                places = gone.values.to_numpy()
                bits = np.ones((int(places.max()) // 8 + 1) * 8, np.uint8)  # whole bytes
                bits[places] = 0
                bitmaps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bitmaps, pa.binary())], ["doc", "text_hash", "bitmap"])

    return per_document.mapInArrow(run, f"doc {id_type}, text_hash long, bitmap binary")


def apply_bitmap(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, remaining text."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    kept = [line for i, line in enumerate(lines) if i not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 1,
                min_docs: int = MIN_DOCS, keep_first: bool = False, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The id, the columns of ``keep``, n_lines, n_dropped and the remaining text (or its SHA-256 with ``digest``) per row."""
    marks = keep_bitmaps(dropped_lines(line_rows(docs, id_column, text_column, min_chars), min_docs, keep_first))
    kept = [id_column, *(keep or [])]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)],
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_body"), F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("_hash"))
    joined = rows.join(marks, rows["k0"].eqNullSafe(marks["doc"]) & (rows["_hash"] == marks["text_hash"]), "left")
    # Bitmap length and bitmap precede the text, so that one binary column reaches the applying function.
    packed = F.concat(
        F.coalesce(F.expr("unhex(lpad(hex(octet_length(bitmap)), 8, '0'))"), F.expr("X'00000000'")),
        F.coalesce(F.col("bitmap"), F.expr("X''")), F.encode("_body", "UTF-8"))
    last = "kept_sha256 string" if digest else "text string"

    def compute(packs: list[bytes]) -> list[list]:
        out = []
        for pack in packs:
            size = int.from_bytes(pack[:4], "big")
            n, gone, text = apply_bitmap(pack[4 + size:], pack[4:4 + size] if size else None)
            out.append((n, gone, hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8")))
        return [list(x) for x in zip(*out)]

    made = map_texts(joined, [(f"k{i}", f"k{i}") for i in range(len(kept))], packed, compute, f"n_lines long, n_dropped long, {last}", binary=True)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "n_lines", "n_dropped", last.split()[0])
