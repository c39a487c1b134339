"""Consistent hashing: ring points, owners, replica sets, and what a change of members moves.

The ring is metadata of nodes * vnodes rows, which the caller fixes; it is broadcast. Keys find their point by an equi
join on the upper twelve bits of the hash, with the interval as a condition, so no key meets every point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.functions.hashing import fnv1a64, unsigned

MOST_POINTS = 100_000


def points(spark: SparkSession, nodes: list[str], vnodes: int = 100) -> DataFrame:
    """node, u: places of `node#i`, in an order like that of the unsigned hash."""
    if len(nodes) * vnodes > MOST_POINTS:
        raise ValueError(f"a ring may have {MOST_POINTS} points")
    base = spark.createDataFrame([(n,) for n in nodes], "node string")
    numbered = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1)))) if nodes else base.withColumn("i", F.lit(0))
    return numbered.select("node", unsigned(fnv1a64(F.concat("node", F.lit("#"), F.col("i").cast("string")))).alias("u"))


def remove(ring: DataFrame, node: str) -> DataFrame:
    return ring.where(F.col("node") != node)


def preference(ring: DataFrame, n: int) -> DataFrame:
    """Per point: from_u, u (its interval, ends included), bucket, owners (the first n distinct nodes clockwise).

    The points come to the driver, so that the lists are walked once and not in each query that uses them.
    """
    rows = sorted((r["u"], r["node"]) for r in ring.limit(MOST_POINTS + 1).collect())
    if len(rows) > MOST_POINTS:
        raise ValueError(f"a ring may have {MOST_POINTS} points")
    nodes, lists, low = len({n for _, n in rows}), [], -(1 << 63)
    for k, (u, _) in enumerate(rows):
        found: list[str] = []
        for j in range(len(rows)):
            node = rows[(k + j) % len(rows)][1]
            if node not in found:
                found.append(node)
            if len(found) >= min(n, nodes):
                break
        lists.append(found)
    out = []
    for (u, _), found in zip(rows, lists):
        if low <= u:  # of points at one place the first counts
            out.append((low, u, found))
            low = u + 1
    if rows and low < 1 << 63:  # past the last point the walk begins again at the first one
        out.append((low, (1 << 63) - 1, lists[0]))
    table = ring.sparkSession.createDataFrame(out, "from_u bigint, u bigint, owners array<string>")
    return table.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("from_u")), _bucket(F.col("u")))))


def _bucket(u: Column) -> Column:
    return F.shiftright(u, 52).cast("int") + 2048


def owners(keys: DataFrame, ring: DataFrame, n: int = 1) -> DataFrame:
    """Adds owners, ARRAY<STRING>; null on an empty ring."""
    hashed = keys.withColumn("_u", unsigned(fnv1a64(F.col("key")))).withColumn("_b", _bucket(F.col("_u")))
    lists = F.broadcast(preference(ring, n))
    found = hashed.join(lists, (F.col("_b") == F.col("bucket")) & F.col("_u").between(F.col("from_u"), F.col("u")), "left")
    return found.select(*keys.columns, "owners")


def owner(keys: DataFrame, ring: DataFrame) -> DataFrame:
    return owners(keys, ring, 1).withColumn("owner", F.get("owners", F.lit(0))).drop("owners")


def peers_except(owners_: Column, self_id: str) -> Column:
    return F.array_remove(owners_, self_id)


def route(owner_: Column, self_id: str) -> Column:
    """LOCAL, or where to go; without an owner the command is served here."""
    return F.when(owner_.isNull() | (owner_ == self_id), "LOCAL").otherwise(F.concat(F.lit("MOVED "), owner_))


def is_local(owner_: Column, self_id: str) -> Column:
    return F.coalesce(owner_ == self_id, F.lit(False))


def rebuild(members: DataFrame, vnodes: int = 100) -> DataFrame:
    """The ring of the alive members, of which there may be MOST_POINTS / vnodes."""
    ids = [r["id"] for r in members.where(F.col("state") == 0).select("id").distinct().orderBy("id").limit(MOST_POINTS // vnodes + 1).collect()]
    return points(members.sparkSession, ids, vnodes)
