"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

A key walks a sequence of jump points 0 = b0 < b1 < ...; with n shards it lives in the last point
below n. One more shard therefore takes only the keys that have n among their jump points, about
1/(n+1) of them, and no key moves between old shards. There is no ring table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Fixed values of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64 over 32-bit halves; no product reaches 2**63, so
    ANSI overflow checks never fire."""

    def times(x: Column, m: int) -> tuple[Column, Column]:
        """x * m as (low part below 2**49, high part in units of 2**32)."""
        p0, p1 = x * F.lit(m & 0xFFFF), x * F.lit(m >> 16)
        return p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16), F.shiftright(p1, 16)

    m_lo, m_hi = MULTIPLIER & _LOW, MULTIPLIER >> 32
    low, up = times(lo, m_lo)
    low = low + F.lit(1)
    cross = [part for x, m in ((lo, m_hi), (hi, m_lo)) for part in times(x, m)[:1]]
    high = F.shiftright(low, 32) + up + cross[0] + cross[1]
    return high.bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_shards(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard of an integer key among ``shards`` and among one more."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(0).cast("long").alias("next"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def walk(state: Column, _: Column) -> Column:
        hi, lo = _step(state["hi"], state["lo"])
        span = F.lit(2147483648.0) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            F.floor((state["next"] + F.lit(1)).cast("double") * span).alias("next"),
            F.when(state["next"] < shards, state["next"]).otherwise(state["shard"]).alias("shard"),
            state["next"].alias("grown"),
        )
        return F.when(state["next"] > shards, state).otherwise(moved)

    # every step jumps ahead by one at least, so shards + 1 steps pass both ends
    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, walk)
    return F.transform(F.array(end), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))[0]


def shard_rows(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row its shard by key and a gapless slot in it, by ascending key.

    Returns key, size (UTF-8 bytes and one), text_crc32, law, shard, slot, grown_shard. Null texts
    count as empty; rows without a key share the key -1; repeated keys share a shard and get slots
    of their own. Other columns are not read.

    The slot needs no window over a shard: rows are range-dealt by (shard, key) and numbered by
    position, and the first number and the row counts of each (partition, shard), a table of
    partitions + shards rows at most, are turned into offsets.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    at = jump_shards(F.coalesce(F.col(key).cast("long"), F.lit(-1)), shards)
    thin = df.select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        at.alias("at"),
    ).select(key, "size", "text_crc32", "at.shard", F.col("at.grown").alias("grown_shard"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", key, "text_crc32", "size"]
    numbered = materialise(
        thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "shards",
    ).withColumn("part", F.shiftright("at", 33))
    heads = numbered.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # at most one row for each partition and one more for each shard: a proven size
    return numbered.join(F.broadcast(heads), ["part", "shard"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), "grown_shard"
    )


#: Jump points by recursion over 128-bit integers; CRC-32 by its table, a byte at a time.
ORACLE = """
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS l FROM bits WHERE k = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, strlen(text) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a // 256, l[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM docs, tab),
jump(doc_id, key, b, shard, grown) AS (
  SELECT DISTINCT doc_id, doc_id::HUGEINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM docs
  UNION ALL
  SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616,
    CAST(floor((b + 1) * (2147483648.0::DOUBLE / (((key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE)) AS BIGINT),
    CASE WHEN b < 16 THEN b ELSE shard END, b
  FROM jump WHERE b <= 16),
placed AS (SELECT doc_id, shard, grown FROM jump WHERE b > 16)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, CAST(p.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id, s.text_crc32, s.size) - 1 AS slot, CAST(p.grown AS INTEGER) AS grown_shard
FROM sized s JOIN placed p ON p.doc_id = s.doc_id
"""
