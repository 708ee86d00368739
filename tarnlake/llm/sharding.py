"""Sharding by weighted rendezvous hashing of record keys.

Every shard draws a score for a key, weight / -ln(u) with u from a hash of key and shard, and the highest score takes the record. A further
shard takes records only into itself, and a changed weight moves only what it must.

Nulls: a null text has no bytes (size 1); a null doc_id is one key like any other. Repeated rows go to one shard and get slots of their own. Of
equal scores the shard of the larger number wins. Very long texts are read whole and not kept. An empty table gives no rows; columns other
than doc_id and text are left aside, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tarnlake.llm import common as C

SHARDS, ROWS_A_BLOCK = 16, 50_000


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """A shard's score for a key; 53 bits of the hash make a number above 0 and below 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct<score, shard> of the winner; shards of weight 0 take nothing."""
    return F.array_max(F.array(*(F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0)))


def shard(docs: DataFrame, weights: list[float] | None = None, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard when one of weight 1 is added).

    Slots: rows of a shard fall into blocks by hash; a block's first slot is the sum of the blocks before it, so no task numbers a whole shard.
    """
    weights = weights or [1.0] * SHARDS
    text = C.text_of(docs)
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    blocks = -(-max(1, docs.count()) // rows_a_block)
    placed = (
        slim.withColumn("best", rendezvous(F.col("doc_id"), weights))
        .withColumn("shard", F.col("best.shard"))
        .withColumn("grown_shard", F.when(score(F.col("doc_id"), len(weights)) > F.col("best.score"), F.lit(len(weights))).otherwise(F.col("shard")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.spark_partition_id()), F.lit(blocks)))
        .drop("best")
    )
    placed = C.written(placed, "placed")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("n", F.row_number().over(within))
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), "grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards."""
    return shard(C.table(spark, sf_dir, "documents"))
