"""The 64-bit key hash (FNV-1a over UTF-8 bytes, then a finaliser), shards, and per-key sampling. Hashes are the bits of an
unsigned number in a bigint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
OFFSET, PRIME = 14695981039346656037, 1099511628211
MIX_1, MIX_2, SHIFT = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 33
MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_key(key: str) -> int:
    """The hash of one key, unsigned."""
    h = OFFSET
    for b in key.encode():
        h = (h ^ b) * PRIME & MASK
    for mul in (MIX_1, MIX_2):
        h ^= h >> SHIFT
        h = h * mul & MASK
    return h ^ h >> SHIFT


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """bigint arithmetic that wraps, for expressions analysed inside; the mode stays with them."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _hash(key: Column) -> Column:
    digits = F.hex(F.encode(key, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    h = F.aggregate(octets, F.lit(signed(OFFSET)), lambda h, b: h.bitwiseXOR(b) * F.lit(PRIME))

    def final(h: Column) -> Column:
        for mul in (MIX_1, MIX_2):
            h = h.bitwiseXOR(F.shiftrightunsigned(h, SHIFT)) * F.lit(signed(mul))
        return h.bitwiseXOR(F.shiftrightunsigned(h, SHIFT))

    return F.transform(F.array(h), final)[0]


def with_hash(df: DataFrame, key: str = "key", out: str = "key_hash") -> DataFrame:
    """``df`` with the hash of a string column."""
    with wrapping(df.sparkSession):
        return df.withColumn(out, _hash(F.col(key)))


def unsigned(h: Column) -> Column:
    """As a decimal of 20 digits."""
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unsigned_order(h: Column) -> Column:
    """A bigint that orders as the unsigned hash does."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def pow2(n: int, default: int = 256) -> int:
    """The next power of two; ``default`` for nothing positive."""
    return default if n <= 0 else 1 << (n - 1).bit_length()


def shard_of(h: Column, shards: int) -> Column:
    """Low bits (P2)."""
    return h.bitwiseAND(F.lit(pow2(shards) - 1))


def sampled(h: Column, denominator: int) -> Column:
    """Whether a key is traced: high bits, so that it doesn't depend on the shard; all records of a key or none."""
    mask = pow2(denominator, 1) - 1
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask)) == 0
