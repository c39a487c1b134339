"""Sibling sets: versions of a key that none supersedes, in the order they arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkv.functions import clocks


def last_of_writer(versions: DataFrame, *key: str) -> DataFrame:
    """Each writer's last version of a key: its earlier ones are superseded, since a writer's clocks only grow.

    Holds while writers apply their own writes first and never lose their counters.
    """
    cols = [c for c in versions.columns if c not in (*key, "coord")]
    last = F.max_by(F.struct(*cols), F.col("seq")).alias("_v")
    return versions.groupBy(*key, "coord").agg(last).select(*key, "coord", *[F.col(f"_v.{c}").alias(c) for c in cols])


def supersedes(w: Column, v: Column) -> Column:
    """Of two versions (clock, seq): w's clock is above v's, or equal to it and w came first."""
    above, below = F.coalesce(clocks.exceeds(w["clock"], v["clock"]), F.lit(False)), F.coalesce(clocks.exceeds(v["clock"], w["clock"]), F.lit(False))
    return ~below & (above | (w["seq"] < v["seq"]))


#: Versions of a key that one piece holds; each is compared with the others of its piece.
PIECE = 16


def reconcile(versions: DataFrame, *key: str, levels: int = 3) -> DataFrame:
    """Versions that no other of their key dominates; of equal clocks the first to arrive (by seq) stays. Nothing is assumed of the writers.

    A key's version with the greatest sum of counters is a survivor; what it supersedes goes first, in a running frame
    that holds one version at a time. Of a history of one version after the other it is all that is left.
    Level by level, the other versions of each key are dealt into pieces of PIECE in the order of their clocks' sums,
    greatest first, and each piece keeps its own survivors: of several such histories one in PIECE is left.
    The last step compares what remains of a key, which is its set of siblings and one in PIECE ** levels of the rest.
    All levels share one shuffle, by key.
    """
    total = F.aggregate(F.map_values(F.coalesce(F.col("clock"), F.create_map().cast(clocks.EMPTY))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    by_sum = Window.partitionBy(*key).orderBy(F.desc("_sum"), "seq")
    top = F.first(F.struct("clock", "seq")).over(by_sum.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(by_sum)
    out = versions.withColumn("_sum", total).withColumn("_top", top)
    out = out.where(~supersedes(F.col("_top"), F.struct("clock", "seq"))).drop("_top")
    for _ in range(levels):
        out = reconcile_few(out.withColumn("_piece", F.floor((nth - 1) / PIECE).cast("int")), *key, "_piece").drop("_piece")
    return reconcile_few(out, *key).drop("_sum")


def reconcile_few(versions: DataFrame, *key: str) -> DataFrame:
    """The same for sets that are known to be small, such as one version per writer: without a join of the versions with themselves."""
    cols = [c for c in versions.columns if c not in key]
    sets = versions.groupBy(*key).agg(F.collect_list(F.struct(*cols)).alias("vs"))

    survivors = F.filter("vs", lambda v: ~F.exists("vs", lambda w: supersedes(w, v)))
    return sets.select(*key, F.explode(survivors).alias("v")).select(*key, *[F.col(f"v.{c}").alias(c) for c in cols])


def live(versions: DataFrame) -> DataFrame:
    return versions.where(~F.col("deleted"))


def frontier(versions: DataFrame, *key: str) -> DataFrame:
    """The greatest counter of each node over a set of versions, in long form."""
    return versions.select(*key, F.explode("clock").alias("node", "counter")).groupBy(*key, "node").agg(F.max("counter").alias("counter"))


def equal(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Per key, whether two sides hold the same set of (value, clock, deleted), in any order."""

    def side(x: DataFrame, n: int) -> DataFrame:
        return x.select(*key, F.struct("value", clocks.canonical(F.col("clock")).alias("clock"), "deleted").alias("v"), F.lit(n).alias("side")).distinct()

    each = side(a, 1).union(side(b, -1)).groupBy(*key, "v").agg(F.sum("side").alias("d"))
    return each.groupBy(*key).agg((F.max(F.abs("d")) == 0).alias("same"))


def reapable(now: Column, grace: int) -> Column:
    """An aggregate: every version is a tombstone that is older than the grace period, in seconds."""
    return F.bool_and(F.col("deleted") & (now - F.col("deleted_at") > grace))
