"""Operator 7, mixing sources to target weights in blocks of words.

The texts of a source, in a pseudorandom order, form one stream of words that is cut into blocks of a
fixed length. Targets per source follow from its weight, with a limit on repetition. Every output
shard draws its number of blocks per source from a multinomial distribution; the running totals of
the draws are scaled so that the sum over all shards meets each source's target. The drawn blocks of
a source are numbered through, and each number is mapped by a pseudorandom permutation of the
source's block indexes, a new one for each pass over the source, so that no block is taken twice
before all are taken once. Joining by block index says what each document contributes.

No step holds a source in one task: the stream position of a document is the sum of its hash bucket's
predecessors (one row for each source and bucket) plus the sum inside the bucket.

Defined cases: a null text has no words and contributes nothing; a null source is a source of its
own, last in order; repeated rows are separate stretches of the stream; if there are no words at all,
targets and contributions are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.session import materialise

BLOCK_WORDS = 256
SLOTS_PER_SHARD = 4096
ROWS_PER_BUCKET = 20_000
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row, nulls told from values: rows with the same hash are interchangeable."""
    parts = []
    for name, kind in docs.dtypes:
        value = F.col(f"`{name}`")
        parts += [F.to_json(F.struct(value)) if "map<" in kind or "variant" in kind else value, value.isNull()]
    return F.xxhash64(*parts)


def n_words(text: str) -> Column:
    return F.expr(f"CAST(regexp_count(coalesce(`{text}`, ''), r'{WORD}') AS LONG)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_factor: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size, source_no, target) from (source, source_size); one row per source.

    Shares by weight stop at ``max_repeat`` times the source; what is left over goes to the others by
    weight. In the order of limit / weight the sources at their limit come first, so running sums
    find the level at which the others stand.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    listed = ",".join(f"{w}D" for w in weights)
    table = (
        sizes.withColumn("source_no", (F.row_number().over(ordered) - 1).cast("int"))
        .withColumn("weight", F.expr(f"element_at(array({listed}), source_no % {len(weights)} + 1)"))
        .withColumn("limit", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("wanted", F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(total_factor)))
        .withColumn("before", F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.coalesce("before", F.lit(0.0))) / F.col("open"))
        .withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
        .withColumn("common", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("source_no"), F.col("level")))).over(
            Window.partitionBy(F.lit(1))).getField("level"))
    )
    # The first source in this order that stays below its limit gives the level of all that stay below.
    return table.selectExpr("source", "source_size", "source_no", "IF(full OR common IS NULL, limit, weight * common) AS target")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size), by four Feistel rounds; numbers outside walk on until inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo, size = index.astype(np.uint64), np.arange(len(index)), size.astype(np.uint64)
    key = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            mix = (right + k + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mix ^ (mix >> np.uint64(29))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def place(docs: DataFrame) -> DataFrame:
    """Adds ``start``, the position of a row's first word in its source's stream; needs source_no, size, order_key, row_hash."""
    n_rows = docs.count()
    buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    rows = docs.withColumn("bucket", F.pmod(F.xxhash64("order_key"), F.lit(buckets)).cast("long"))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = materialise(sums.withColumn("before", F.coalesce(
        F.sum("in_bucket").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("in_bucket"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("order_key", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(before, ["source_no", "bucket"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .drop("bucket", "before")
    )


def draw_slots(spark, sources: DataFrame, block_words: int, slots_per_shard: int, seed: int) -> DataFrame:
    """(shard, source_no, n_blocks, first_slot, n_slots): what each output shard takes of each source."""
    # One row per source, a category: its size does not follow the number of documents.
    plan = [(r["source_no"], r["source_size"], r["target"]) for r in sources.orderBy("source_no").collect()]
    blocks = [-(-size // block_words) for _, size, _ in plan]
    quota = [min(2 * b, int(t * b / s + 0.5)) if s else 0 for b, (_, s, t) in zip(blocks, plan)]
    total = sum(quota)
    shards = max(1, -(-total // slots_per_shard))
    share = [q / total for q in quota] if total else []

    def draw(frames):
        for frame in frames:
            for shard in frame["id"]:
                counts = np.random.default_rng([seed, int(shard)]).multinomial(slots_per_shard, share) if share else []
                yield pd.DataFrame({"shard": int(shard), "source_no": range(len(counts)), "drawn": counts})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source_no int, drawn long")
    known = spark.createDataFrame(
        [(n, b, q) for (n, _, _), b, q in zip(plan, blocks, quota)], "source_no int, n_blocks long, quota long")
    running = Window.partitionBy("source_no").orderBy("shard")
    # A tiny addition spreads a source that was never drawn.
    share_before = "(sum(drawn + 1e-6D) OVER (PARTITION BY source_no ORDER BY shard ROWS UNBOUNDED PRECEDING))" \
                   " / (sum(drawn + 1e-6D) OVER (PARTITION BY source_no))"
    return (
        drawn.join(F.broadcast(known), "source_no")
        .withColumn("_to", F.expr(f"CAST(round(quota * ({share_before})) AS LONG)"))
        .withColumn("first_slot", F.coalesce(F.lag("_to").over(running), F.lit(0)))
        .withColumn("n_slots", F.col("_to") - F.col("first_slot"))
        .select("shard", "source_no", "n_blocks", "first_slot", "n_slots")
    )


def slot_blocks(draws: DataFrame, seed: int) -> DataFrame:
    """(shard, source_no, slot, block): every taken slot with the block that the permutation gives it."""
    slots = draws.filter("n_slots > 0").select(
        "shard", "source_no", "n_blocks", F.explode(F.expr("sequence(first_slot, first_slot + n_slots - 1)")).alias("slot"))

    @F.pandas_udf("long")
    def block(slot: pd.Series, n_blocks: pd.Series, source: pd.Series) -> pd.Series:
        size = n_blocks.to_numpy(np.int64)
        turn = slot.to_numpy(np.int64) // size
        key = (source.to_numpy(np.int64) * 1_000_003 + turn) * 31 + seed
        return pd.Series(permuted(slot.to_numpy(np.int64) % size, size, key))

    return slots.select("shard", "source_no", "slot", block("slot", "n_blocks", "source_no").alias("block"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                weights: tuple[int, ...] = WEIGHTS, total_factor: float = 1.5, block_words: int = BLOCK_WORDS,
                slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots).

    documents: doc_id, text_hash, row_hash, source, source_no, size, source_size, target, start - one row per input row.
    pieces: source_no, start, doc_id, row_hash, size, block, first_word, n_words, times - the stretches of a
    document that lie in taken blocks, and how often each is taken (once or twice).
    slots: shard, source_no, slot, block - the mix itself.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash"),
        row_hash(docs).alias("row_hash"), F.col(f"`{source_column}`").alias("source"), n_words(text_column).alias("size")))
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_factor))
    rows = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).select(
        sized["*"], "source_no", "source_size", "target")
    placed = materialise(place(rows.withColumn("order_key", F.xxhash64("doc_id", "text_hash", F.lit(seed)))).drop("order_key"))
    slots = slot_blocks(draw_slots(spark, sources, block_words, slots_per_shard, seed), seed)
    taken = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    stretches = placed.filter("size > 0").select(
        "source_no", "start", "doc_id", "row_hash", "size",
        F.explode(F.expr(f"sequence(start DIV {block_words}, (start + size - 1) DIV {block_words})")).alias("block"))
    stretches = (
        stretches.withColumn("first_word", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")))
        .withColumn("n_words", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")) - F.col("first_word"))
    )
    pieces = stretches.join(taken, ["source_no", "block"])
    return placed, pieces, slots


def contributions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken per input row."""
    placed, pieces, _ = mix_sources(docs, **options)
    # A row with words is named by its source and position; rows without words take nothing.
    sums = pieces.groupBy("source_no", "start").agg(F.sum(F.col("n_words") * F.col("times")).alias("_taken"))
    key = F.when(F.col("size") > 0, F.col("start"))
    return (
        placed.withColumn("_at", key).alias("p")
        .join(sums.withColumnRenamed("start", "_at"), ["source_no", "_at"], "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"))
    )
