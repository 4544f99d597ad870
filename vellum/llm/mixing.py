"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many words. Slot i takes the point frac((i + 1/2) * golden ratio), in
64-bit whole numbers; the cumulative shares of the sources map it to a source, and the slot's rank among its source's
slots names the block that it plays: block r is words [r*B, (r+1)*B) of the source's documents, laid end to end in
hash order and read round and round, three times at most. sequence() gives the mix in this order, mix() what each
document adds to it and where it is first played.

Ranks and word offsets are running sums in two levels (within a bucket, then over the buckets' sums), so
that no task holds a whole source. One row per source goes to the driver, which shares out the targets: sources are
taken to be few (some million names at most), documents and slots are not bounded.

Null text has size 0; null sources form one source, the last; rows of one doc_id are separate documents;
an empty table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import stored

#: The golden ratio's fraction, times 2^64.
GOLDEN = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of documents, about, and slots of a chunk. Words of a block at most, and slots that a small corpus is cut into at least.
BUCKET_ROWS, CHUNK, BLOCK, LEAST_SLOTS = 1_000, 8_192, 4_096, 1 << 17


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; none above most * size, what is over goes to the others by weight."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        level = left / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * level > most * sizes[k]}
        if not full:
            for k in free:
                out[k] = weights[k] * level
            break
        for k in full:
            out[k] = float(most * sizes[k])
            left -= out[k]
        free -= full
    return out


def schedule(spark: SparkSession, shares: Sequence[float], slots: int) -> DataFrame:
    """slot, sid, rank: the source of each slot and the slot's rank among those of its source."""
    bounds = np.array([min(int(x * 2**64), 2**64 - 1) for x in np.cumsum(np.asarray(shares, float))[:-1]], np.uint64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            point = b["id"].to_numpy().astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN >> 1)
            yield pd.DataFrame({"slot": b["id"], "sid": np.searchsorted(bounds, point, side="right")})

    dealt = spark.range(slots).mapInPandas(deal, "slot long, sid long").withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    before = (
        dealt.groupBy("sid", "chunk")
        .count()
        .select("sid", "chunk", (F.sum("count").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("count")).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return dealt.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + place).alias("rank"))


def _laid(
    df: DataFrame, weights: Sequence[float], most: int, block_words: int, seed: int, id_col: str, text_col: str, source_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with words (and where they start in their source), those without, and the played pieces of the former with their slots."""
    spark = df.sparkSession
    docs = stored(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    found = docs.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is not None and [0, r["source"]]) or [1, ""])
    sizes = [r["n"] for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], most)
    total = sum(sizes)
    block = max(1, min(block_words, -(-total // LEAST_SLOTS)))
    info = spark.createDataFrame(
        [(r["source"], k, r["n"], goal[k]) for k, r in enumerate(found)], "source_ string, sid long, source_size long, target double"
    )
    bits = max(0, (sum(r["rows"] for r in found) // BUCKET_ROWS).bit_length())
    hashed = (
        docs.join(info, F.col("source").eqNullSafe(F.col("source_")))
        .drop("source_")
        .withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    )
    full = hashed.where("size > 0")
    before = (
        full.groupBy("sid", "bucket")
        .agg(F.sum("size").alias("n"))
        .select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    laid = full.join(before, ["sid", "bucket"]).withColumn("start", F.col("before") + F.coalesce(inside, F.lit(0))).select(*KEYS)
    slot_rows = schedule(spark, [g / total for g in goal] if total else [1.0], -(-total // block)).select("sid", F.col("rank").alias("block"), "slot")
    pieces = (
        laid.withColumn("pass_start", F.explode(F.expr(f"transform(sequence(0, {most - 1}), p -> start + p * source_size)")))
        .withColumn("block", F.explode(F.expr(f"sequence(pass_start div {block}, (pass_start + size - 1) div {block})")))
        .withColumn("from", F.expr(f"greatest(0, block * {block} - pass_start)"))
        .withColumn("words", F.expr(f"least(pass_start + size, (block + 1) * {block}) - greatest(pass_start, block * {block})"))
    )
    return laid, hashed.where("size = 0"), pieces.join(slot_rows, ["sid", "block"], "left")


KEYS = ["sid", "start", "doc_id", "source", "size", "source_size", "target"]


def sequence(
    df: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, block_words: int = BLOCK, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix: slot, source, block, place, doc_id, from, words: the words [from, from + words) of a document that a slot plays.

    Sorted by slot and place (the order within the slot's block) the rows are the mix from its beginning to its end.
    """
    pieces = _laid(df, weights, most, block_words, seed, id_col, text_col, source_col)[2]
    return pieces.where("slot IS NOT NULL").select("slot", "source", "block", F.expr("pass_start + from").alias("place"), "doc_id", "from", "words")


def mix(
    df: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    block_words: int = BLOCK,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (null where nothing is taken) for each row.

    Sources by code point, null last, get the weights in turn. block_words: words of a block; fewer where the corpus would
    have less than LEAST_SLOTS slots.
    """
    _, empty, pieces = _laid(df, weights, most, block_words, seed, id_col, text_col, source_col)
    taken = pieces.groupBy(*KEYS).agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken"), F.min("slot").alias("first_slot"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot"]
    empty = empty.withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    return taken.select(*columns).unionByName(empty.select(*columns))
