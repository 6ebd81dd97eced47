"""Shard assignment by jump consistent hashing, in DataFrame functions only.

The key alone decides the shard: a linear congruential sequence seeded with it gives the jump points,
and the last jump below the shard count is the shard. One more shard takes rows only into itself.

Slots number the rows of a shard from 0 without gaps, in the order (doc_id, text_crc32, size), nulls
first. They come from a range partitioning, an index inside each partition and the running sum of a
small table of counts (one row per partition and shard), so no shard is ever gathered in one task. Rows
that are equal in all of these are told apart by their place in the input, so ranges can part them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint

LOW32 = 0xFFFFFFFF
#: Fixed value: the multiplier of the congruential sequence.
MULTIPLIER = 2862933555777941757


def _times_plus_one(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * MULTIPLIER + 1 modulo 2^64, in 32-bit halves so that no product leaves a signed long."""
    m_low, m_high = MULTIPLIER & LOW32, MULTIPLIER >> 32
    m0, m1 = m_low & 0xFFFF, m_low >> 16

    def low_word(a: Column, b: int) -> Column:  # the low 32 bits of a * b
        return (a * F.lit(b & 0xFFFF) + F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW32)

    first, second = low * F.lit(m0) + F.lit(1), low * F.lit(m1)
    summed = first.bitwiseAND(LOW32) + F.shiftleft(second.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(first, 32) + F.shiftright(second, 16) + F.shiftright(summed, 32)
    return (carry + low_word(high, m_low) + low_word(low, m_high)).bitwiseAND(LOW32), summed.bitwiseAND(LOW32)


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among `shards`, and among one more. A null key counts as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(LOW32).alias("low"),
        F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _times_plus_one(state["high"], state["low"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
        jumped = F.struct(
            high.alias("high"), low.alias("low"),
            F.when(state["next"] < shards, state["next"]).otherwise(state["shard"]).alias("shard"), state["next"].alias("grown"),
            ((state["next"] + 1).cast("double") * ratio).cast("long").alias("next"),
        )
        return F.when(state["next"] <= shards, jumped).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    size is the UTF-8 length of the text plus 16; a null text has size 16 and the CRC of the empty text.
    A null doc_id goes where key 0 goes and comes first in the slots. Repeated rows get slots of their
    own. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("jump", jump_hash(F.col("doc_id"), shards))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown_shard"))
    order = ["doc_id", "text_crc32", "size"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").drop("tie").withColumn("part", F.spark_partition_id()).sortWithinPartitions("shard", *order)
    dealt = checkpoint(dealt.withColumn("place", F.monotonically_increasing_id()))  # the range bounds are sampled: fix them once
    counts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "shard", (before - F.col("first")).alias("shift"))
    return dealt.join(starts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard"
    )
