"""Texts of the word stretches that a mix takes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.batches import map_texts
from sensorloom.llm.mixing import row_hash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, stretches: list[tuple[int, int]]) -> bytes:
    """Words first .. first + n - 1 of each stretch with the white space between them; adjoining stretches stay whole."""
    merged: list[list[int]] = []
    for first, n in sorted(stretches):
        if merged and merged[-1][1] == first:
            merged[-1][1] += n
        else:
            merged.append([first, first + n])
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    if len(merged) == 1 and merged[0] == [0, len(places)]:
        return text
    return b"\n".join(text[places[a][0]:places[b - 1][1]] for a, b in merged)


def taken_texts(docs: DataFrame, placed: DataFrame, taken: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text taken in each pass, one row per pass that takes any word.

    Rows that agree in all columns are interchangeable; rows that differ in any are told apart by the hash of all of them.
    """
    passes = taken.withColumn("turn", F.explode(F.expr("sequence(1, CAST(times AS INT))"))).groupBy(
        "doc_id", "row_hash", "source_no", "start", "turn").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(first_word, n_words))), x -> concat(x.first_word, ':', x.n_words)), ',')").alias("stretches"))
    texts = docs.withColumn("_hash", row_hash(docs))
    if not placed.groupBy("doc_id", "row_hash").count().filter("count > 1").isEmpty():
        # The stretches of a repeated row take the same text: one copy of the row is enough for all of them.
        texts = texts.dropDuplicates([id_column, "_hash"])
    passes = passes.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_taken_hash"), "stretches")
    joined = texts.join(passes, (F.col("_hash") == F.col("_taken_hash")) & F.col(f"`{id_column}`").eqNullSafe(F.col("_doc")))
    others = [c for c in docs.columns if c != text_column]
    packed = F.concat(F.encode(F.concat("stretches", F.lit("\n")), "UTF-8"), F.encode(F.col(f"`{text_column}`"), "UTF-8"))

    def compute(packs: list[bytes]) -> list[list]:
        out = []
        for pack in packs:
            head, _, text = pack.partition(b"\n")
            out.append(cut(text, [tuple(map(int, x.split(b":"))) for x in head.split(b",")]).decode("utf-8"))
        return [out]

    return map_texts(joined, [(c, c) for c in others], packed, compute, "text string", binary=True)
