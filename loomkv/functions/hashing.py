"""Hash expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = -3750763034362895579
LOW32 = 4294967295


def unsigned(h: Column) -> Column:
    """A signed long whose order is that of the unsigned hash."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def fnv1a64(key: Column) -> Column:
    """FNV-1a over the key's UTF-8 bytes, as a signed long. Products are taken in 32-bit halves, since longs may not overflow."""
    raw = F.encode(key, "UTF-8")
    n = F.octet_length(key)
    places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))
    codes = F.transform(places, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        low = x.bitwiseAND(F.lit(LOW32)) * 435
        high = F.shiftrightunsigned(h, 32) * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(LOW32)), 8)
        return F.shiftleft(high.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))

    return F.aggregate(codes, F.lit(SEED).cast("bigint"), step)


def merkle_bucket(key: Column, leaves: int) -> Column:
    """The low bits of the first eight bytes of sha256(key); leaves is a power of two up to 2^31."""
    if leaves & (leaves - 1) or not 1 <= leaves <= 1 << 31:
        raise ValueError("leaves must be a power of two up to 2^31")
    return F.conv(F.substring(F.sha2(key, 256), 9, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(leaves - 1).cast("bigint")).cast("int")


def md5_halves(key: Column) -> tuple[Column, Column]:
    """Two unsigned 32-bit numbers from the key's md5, for places whose hash has no meaning elsewhere: compiled, unlike a fold over bytes."""
    return tuple(F.conv(F.substring(F.md5(key), 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(2))


def limbs(hex_digest: Column) -> list[Column]:
    """A sha256 digest as eight unsigned 32-bit numbers."""
    return [F.conv(F.substring(hex_digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]


def shard_of(key: Column, shards: int) -> Column:
    """Placement by hash; which shard it is has no meaning outside one run of a plan."""
    return F.pmod(md5_halves(key)[0], F.lit(shards)).cast("int")


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()
