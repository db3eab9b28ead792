"""A Bloom sketch of a batch's keys, by which a large table is thinned before a join.

The sketch is made of Spark's own bitmaps, 32,768 bits to a row, and is never
larger than ``MOST_BITS``; so it travels by broadcast whatever the batch holds.
Rows of the table whose key the batch cannot have fall out where they are read,
and only what is left (the batch's keys and a small share of others) is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bits set for a key, and bits provided for one: about 1 in 200 others passes.
HASHES = 3
BITS_PER_KEY = 16
# Fixed value: bits of one of Spark's bitmaps.
BITMAP = 32_768
LEAST_BITS = BITMAP
# 32 MB. Beyond 16 million keys more others pass, and the join sorts them out.
MOST_BITS = 1 << 28


def sketch_bits(keys: int) -> int:
    """The size of a sketch for so many keys."""
    return max(LEAST_BITS, min(MOST_BITS, -(-keys * BITS_PER_KEY // BITMAP) * BITMAP))


def places(key: Column, bits: int) -> list[Column]:
    """The bits that stand for a key."""
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits).cast("long")) for k in range(HASHES)]


def sketch(keys: DataFrame, key: str, count: int) -> DataFrame:
    """``(number, bitmap)``: the sketch of about ``count`` keys."""
    bits = sketch_bits(count)
    marked = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*places(F.col(key), bits))).alias("bit"))
    number = F.floor(F.col("bit") / BITMAP).alias("number")
    return marked.groupBy(number).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bitmap"))


def members(table: DataFrame, key: str, made: DataFrame, count: int) -> DataFrame:
    """The rows of ``table`` whose key may be among those of the sketch ``made`` for ``count``."""
    left = table
    for at in places(F.col(key), sketch_bits(count)):
        found = F.broadcast(made)
        inside = at % BITMAP
        byte = F.conv(F.hex(F.substring("bitmap", (F.floor(inside / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("bit_get", byte, (inside % 8).cast("int")) == 1
        left = left.join(found, F.floor(at / BITMAP) == F.col("number")).where(hit).drop("number", "bitmap")
    return left
