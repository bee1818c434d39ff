"""SNK-4, CAP-8: the partition that a keyed log gives a record, as column expressions.

Keyed logs place a record by the 32-bit murmur2 hash of its key's bytes, sign
bit cleared, modulo the number of partitions. The arithmetic runs in longs below
2^63, masked to 32 bits after each step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
SEED = 0x9747B28C
MULTIPLIER = 0x5BD1E995
MASK = 0xFFFFFFFF


def _times(x: Column) -> Column:
    return (x * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))


def _fold(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, bits))


def murmur2(text: Column) -> Column:
    """The unsigned murmur2 hash of a text's UTF-8 bytes (a long below 2^32); NULL for NULL."""
    data = F.hex(text.cast("binary"))
    size = F.octet_length(text).cast("bigint")

    def byte(i: Column) -> Column:
        return F.conv(F.substr(data, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")

    def word(i: Column) -> Column:
        return byte(i) + byte(i + 1) * 256 + byte(i + 2) * 65536 + byte(i + 3) * 16777216

    whole = F.floor(size / 4)
    blocks = F.when(whole > 0, F.sequence(F.lit(0).cast("bigint"), whole - 1)).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(blocks, size.bitwiseXOR(F.lit(SEED)), lambda h, i: _times(h).bitwiseXOR(_times(_fold(_times(word(i * 4)), 24))))
    at, rest = whole * 4, size % 4
    tail = F.when(rest > 0, byte(at)).otherwise(0) + F.when(rest > 1, byte(at + 1) * 256).otherwise(0) + F.when(rest > 2, byte(at + 2) * 65536).otherwise(0)
    h = F.when(rest > 0, _times(h.bitwiseXOR(tail))).otherwise(h)
    return _fold(_times(_fold(h, 13)), 15)


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a record with the text ``key``; a NULL key has none (such records may go anywhere)."""
    return (murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")
