"""Jump consistent hashing of stable keys to shards.

The key is hashed to 64 bits and seeds a linear congruential generator; each draw jumps to the next shard count at
which the key would move, until the jump passes the number of shards. No ring table exists, and one more shard takes
only the keys whose last jump lands on it. All arithmetic stays in JVM long expressions (32-bit halves, since ANSI
mode rejects the overflow that the generator needs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_of

#: Multiplier of the generator (fixed value).
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 modulo 2**64, as halves."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    a, b = m_lo >> 16, m_lo & 0xFFFF
    mask, low16 = F.lit(MASK), F.lit(0xFFFF)
    low = lo * b + F.shiftleft((lo * a).bitwiseAND(low16), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(lo * a, 16)
    cross = (lo * m_hi).bitwiseAND(mask) + (hi * b).bitwiseAND(mask) + F.shiftleft((hi * a).bitwiseAND(low16), 16)
    return (carry + cross).bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hashes(key: Column, shards: int) -> Column:
    """Struct of ``now``, the shard of a long key among ``shards``, and ``grown``, the one among ``shards`` + 1.

    One fold gives both: the jumps are the same, ``now`` is the last one below ``shards``. A null key hashes like any other
    value upstream, so it never arrives here.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        to = F.floor((s["j"] + 1) * (F.lit(2.0**31) / (F.shiftright(hi, 1) + 1))).cast("long")
        now = F.when(s["j"] < shards, s["j"]).otherwise(s["now"])
        return F.when(s["j"] <= shards, F.struct(hi.alias("hi"), lo.alias("lo"), now.alias("now"), s["j"].alias("grown"), to.alias("j"))).otherwise(s)

    none = F.lit(-1).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"), none.alias("now"), none.alias("grown"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump, lambda s: F.struct(s["now"].cast("int").alias("now"), s["grown"].cast("int").alias("grown")))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to shards-1 of a long key."""
    return jump_hashes(key, shards)["now"]


#: Rows that are numbered in one task.
NUMBERED = 1_000_000


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", numbered: int = NUMBERED) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the number of shards decide alone. Null ids share one key; rows that repeat an id share its
    shard. Slots count from 0 in each shard without gaps: rows get a number when they are written, are dealt by it to blocks of
    about ``numbered`` rows, numbered inside (shard, block), and the blocks' offsets are added. So no task holds a whole shard,
    nor all rows of one id. The offsets are a row for each ``numbered`` input rows. Null and empty texts have size 1; texts of any length count
    whole; an empty table gives an empty result; columns other than id and text are not read.
    """
    text = text_of(text_col)
    to = jump_hashes(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), shards)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), to.alias("to"), F.monotonically_increasing_id().alias("seq"))
    rows = durable(rows.select("id", "size", "text_crc32", F.col("to.now").alias("shard"), F.col("to.grown").alias("grown_shard"), "seq"), "shards")
    blocks = max(1, -(-rows.count() // (numbered * shards)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("seq"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("seq")
    return rows.withColumn("r", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("r") + F.col("offset")).cast("long").alias("slot"), "grown_shard",
    )
