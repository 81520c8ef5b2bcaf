"""Jump consistent hashing of stable keys to shards, in SQL expressions.

The published recurrence needs 64-bit products that wrap. Spark's products
raise on overflow, so the state is held as two 32-bit halves and multiplied by
16-bit parts. With one more shard, a key keeps its shard or moves to the new one.

Nulls: a null key hashes as such, to one shard; a null text has no bytes.
Repeated rows of a key share its shard and get slots of their own. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import parallelism

#: Fixed value: the multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757
_MASK = (1 << 32) - 1


def _times(a: Column, b: int) -> tuple[Column, Column]:
    """Low 32 bits, and what carries over, of a 32-bit ``a`` by a 32-bit ``b``."""
    low, high = a * F.lit(b & 0xFFFF), a * F.lit(b >> 16)
    total = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return total.bitwiseAND(F.lit(_MASK)), F.shiftright(total, 32) + F.shiftright(high, 16)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit ``key`` among ``shards``."""
    mask, al, ah = F.lit(_MASK), MULTIPLIER & _MASK, MULTIPLIER >> 32

    def step(s: Column, _: Column) -> Column:
        low, carry = _times(s.lo, al)
        high = (carry + _times(s.lo, ah)[0] + _times(s.hi, al)[0]).bitwiseAND(mask)
        low1 = low + 1
        lo, hi = low1.bitwiseAND(mask), (high + F.shiftright(low1, 32)).bitwiseAND(mask)
        jump = F.floor((s.j + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        going = s.j < shards
        return F.struct(F.when(going, s.j).otherwise(s.b).alias("b"), F.when(going, jump).otherwise(s.j).alias("j"), lo.alias("lo"), hi.alias("hi"))

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.bitwiseAND(mask).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s.b.cast("int"))


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Size, checksum, shard and slot of each row, and its shard if there were one more.

    Slots are counted in two steps, by blocks of keys, so that no task holds a whole shard.
    """
    spark = df.sparkSession
    hashed = F.xxhash64(F.col(key))
    blocks = 16 * parallelism(spark)
    place = df.select(F.col(key).alias(key), jump_shard(hashed, shards).alias("shard"), F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(blocks)).alias("block"))
    counts = place.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = df.select(
        F.col(key).alias(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), jump_shard(hashed, shards).alias("shard"),
        F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(blocks)).alias("block"), jump_shard(hashed, shards + 1).alias("grown_shard"),
    )
    order = Window.partitionBy("shard", "block").orderBy(key, "text_crc32", "size")
    ranked = rows.withColumn("at", F.row_number().over(order) - 1).join(bases, ["shard", "block"])
    return ranked.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), "grown_shard")
