"""A count-min sketch of four rows with counters up to 15."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkv.functions.hashing import md5_halves, next_power_of_two

DEPTH, MOST = 4, 15


def cells(key: Column, capacity: int) -> Column:
    """Column of each row: h1 + row * h2, by the halves of the key's hash."""
    h1, h2 = md5_halves(key)
    mask = next_power_of_two(max(1, capacity)) - 1
    return F.array(*[(h1 + r * h2).bitwiseAND(F.lit(mask)) for r in range(DEPTH)])


def build(touches: DataFrame, capacity: int) -> DataFrame:
    """row, col, n without ageing. Keys are counted before their hash is taken."""
    per_key = touches.groupBy("key").agg(F.count("*").alias("k"))
    each = per_key.select("k", F.posexplode(cells(F.col("key"), capacity)).alias("row", "col"))
    return each.groupBy("row", "col").agg(F.least(F.lit(MOST), F.sum("k")).cast("bigint").alias("n"))


def estimate(keys: DataFrame, sketch: DataFrame, capacity: int) -> DataFrame:
    """key, estimate; the sketch has at most 4 * 2 * capacity rows, which are broadcast up to half a million."""
    each = keys.select("key", F.posexplode(cells(F.col("key"), capacity)).alias("row", "col"))
    found = each.join(F.broadcast(sketch) if capacity <= 1 << 16 else sketch, ["row", "col"], "left")
    return found.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("estimate"))


def halve(sketch: DataFrame) -> DataFrame:
    return sketch.withColumn("n", F.shiftright("n", 1))


class Sketch:
    """The same with ageing, as state of a replay: at ten times the capacity all counters are halved."""

    def __init__(self, capacity: int):
        self.width = next_power_of_two(max(1, capacity))
        self.limit, self.size = 10 * max(1, capacity), 0
        self.cells = [[0] * self.width for _ in range(DEPTH)]

    def _at(self, key: str) -> list[int]:
        h = int.from_bytes(hashlib.md5(key.encode()).digest()[:8])
        return [((h >> 32) + r * (h & 0xFFFFFFFF)) & (self.width - 1) for r in range(DEPTH)]

    def add(self, key: str) -> None:
        for row, c in zip(self.cells, self._at(key)):
            row[c] = min(MOST, row[c] + 1)
        self.size += 1
        if self.size >= self.limit:
            self.reset()

    def estimate(self, key: str) -> int:
        return min(row[c] for row, c in zip(self.cells, self._at(key)))

    def reset(self) -> None:
        self.cells = [[c >> 1 for c in row] for row in self.cells]
        self.size = 0
