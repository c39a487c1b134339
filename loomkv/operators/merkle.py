"""Merkle trees of two replicas: leaves, root, differing buckets, and their entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.functions.hashing import limbs, merkle_bucket, next_power_of_two

LIMBS = [f"l{i}" for i in range(8)]


def bucket_of(key: Column, count: int) -> Column:
    return merkle_bucket(key, next_power_of_two(count))


def digest(key: Column, blob: Column) -> Column:
    """sha256 over the key's digest and the blob, in hex; the key's part has a fixed width."""
    return F.sha2(F.concat(F.unhex(F.sha2(key, 256)), F.encode(blob, "UTF-8")), 256)


def leaves(entries: DataFrame, count: int = 1024) -> DataFrame:
    """bucket, l0..l7: exclusive or of the digests, aggregated before it is moved; empty buckets have no row."""
    n = next_power_of_two(count)
    hashed = entries.select(merkle_bucket(F.col("key"), n).alias("bucket"), digest(F.col("key"), F.col("blob")).alias("d"))
    return hashed.select("bucket", *[x.alias(LIMBS[i]) for i, x in enumerate(limbs(F.col("d")))]).groupBy("bucket").agg(*[F.bit_xor(c).alias(c) for c in LIMBS])


def hex_of(*parts: str) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(c), 8, "0")) for c in parts])


def root(tree: DataFrame, count: int = 1024) -> DataFrame:
    """One row, hex: sha256 of children, level by level; a leaf without entries is empty. The tree has `count` leaves, a constant."""
    n = next_power_of_two(count)
    nodes = tree.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")).join(tree.select("bucket", hex_of(*LIMBS).alias("h")), "bucket", "left")
    nodes = nodes.select("bucket", F.coalesce("h", F.lit("")).alias("h"))
    while n > 1:
        pair = nodes.groupBy(F.floor(F.col("bucket") / 2).cast("int").alias("b")).agg(F.max(F.when(F.col("bucket") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("bucket") % 2 == 1, F.col("h"))).alias("r"))
        nodes = pair.select(F.col("b").alias("bucket"), F.sha2(F.unhex(F.concat("l", "r")), 256).alias("h"))
        n //= 2
    return nodes.select(F.col("h").alias("root"))


def diff(a: DataFrame, b: DataFrame, count_a: int = 1024, count_b: int = 1024) -> DataFrame:
    """Buckets whose leaves differ; trees of different sizes can't be compared."""
    if next_power_of_two(count_a) != next_power_of_two(count_b):
        raise ValueError("trees of different sizes")
    x, y = a.alias("x"), b.alias("y")
    same = F.lit(True)
    for c in LIMBS:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return x.join(y, F.col("x.bucket") == F.col("y.bucket"), "full_outer").where(~same).select(F.coalesce("x.bucket", "y.bucket").alias("bucket"))


def fetch(entries: DataFrame, buckets: DataFrame, count: int = 1024) -> DataFrame:
    """Entries of the buckets, at most `count` of them, in one scan."""
    n = next_power_of_two(count)
    return entries.withColumn("bucket", merkle_bucket(F.col("key"), n)).join(F.broadcast(buckets), "bucket", "left_semi")


def save(tree: DataFrame, path: str, count: int = 1024) -> None:
    """The leaves alone, with the number of leaves; inner nodes follow from them."""
    tree.withColumn("leaves", F.lit(next_power_of_two(count))).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    saved = spark.read.parquet(path)
    first = saved.select("leaves").first()
    return saved.drop("leaves"), first[0] if first else 1
