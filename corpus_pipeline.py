"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the rows are written as Parquet.

A row that a stage keeps but for which it has nothing left (an empty text) goes on as it is. Null texts
and texts without words fail the quality rules. The mix gives a document once for every pass in which
any of its words are taken, with the words of that pass; a document of which nothing is taken is gone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.llm import line_dedup, mixing, pieces, quality, spans, weighted_minhash
from sensorloom.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs, keep=["text", "lang", "source", "n_chars"]).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, keep=["lang", "source"])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return weighted_minhash.near_duplicates_removed(docs, share=None).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes: a document appears once for each pass that takes words of it."""
    placed, taken, _ = mixing.mix_sources(docs)
    return spans.taken_texts(docs, placed, taken).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of ids and decoded texts."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("source_mix", mixing_stage),
    ("piece_encoding", encoding_stage),
]

#: Sampling by near-duplicate buckets, block permutations and the vocabulary cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the rows that the one before has written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}_{name}")
        docs = spark.read.parquet(f"{folder}/{number}_{name}")
    return docs
