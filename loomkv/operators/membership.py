"""Gossip membership: merged claims, liveness, failures, transitions, and rounds of dissemination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALIVE, SUSPECT, DEAD = 0, 1, 2


def merge(claims: DataFrame, self_id: str) -> DataFrame:
    """id, addr, state, incarnation. The higher incarnation wins, then the deader state; the address is that of the winner's first claim.

    A claim that self isn't alive is answered by an incarnation above all such claims; other news about self is ignored.
    """
    top = F.max(F.struct("incarnation", "state"))
    addr = F.min_by("addr", F.struct((-F.col("incarnation")).alias("i"), F.col("arrival").alias("a")))
    others = claims.where(F.col("id") != self_id).groupBy("id").agg(addr.alias("addr"), top.alias("_t")).select("id", "addr", "_t.state", "_t.incarnation")
    first = F.min_by("addr", "arrival")
    against = F.max(F.when(F.col("state") != ALIVE, F.col("incarnation") + 1))
    me = claims.where(F.col("id") == self_id).groupBy("id").agg(first.alias("addr"), F.lit(ALIVE).alias("state"), F.greatest(F.coalesce(against, F.lit(0)), F.lit(0)).cast("bigint").alias("incarnation"))
    return others.union(me)


def alive(members: DataFrame) -> DataFrame:
    return members.where(F.col("state") == ALIVE)


def nodes_reply(members: DataFrame) -> DataFrame:
    return alive(members).select(F.concat_ws(" ", "id", "addr").alias("line"))


def detect_failures(members: DataFrame, self_id: str, now, timeout: int) -> DataFrame:
    """Alive members other than self that were silent for longer than the timeout become dead; last_seen and now are in the timeout's unit."""
    dead = (F.col("state") == ALIVE) & (F.col("id") != self_id) & (now - F.col("last_seen") > timeout)
    return members.withColumn("state", F.when(dead, DEAD).otherwise(F.col("state")).cast("int"))


def bump(members: DataFrame, self_id, now=None) -> DataFrame:
    """The incarnation of self, one higher; where now is given, last_seen is set to it."""
    me = F.col("id") == self_id
    out = members.withColumn("incarnation", F.when(me, F.col("incarnation") + 1).otherwise(F.col("incarnation")))
    return out if now is None else out.withColumn("last_seen", F.when(me, now).otherwise(F.col("last_seen")))


def _order(seed: int, *ids: str) -> Column:
    """A random order that any engine can give: the seed decides."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *ids))


def transitions(history: DataFrame) -> DataFrame:
    """id, arrival, event where a member's accepted state changes: joined, recovered, or changed.

    A claim is accepted if it is the first, or ranks above all before it by (incarnation, state).
    """
    w = Window.partitionBy("id").orderBy("arrival")
    before = F.max(F.struct("incarnation", "state")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rated = history.withColumn("_b", before).where(F.col("_b").isNull() | (F.struct("incarnation", "state") > F.col("_b")))
    event = F.when(F.col("_b").isNull(), "joined").when(F.col("state") == F.col("_b.state"), None).when(F.col("state") == ALIVE, "recovered").otherwise("changed")
    return rated.withColumn("event", event).where(F.col("event").isNotNull()).select("id", "arrival", "event", F.col("_b.state").alias("was"), F.col("state").alias("now"))


def gossip_round(spark: SparkSession, views: DataFrame, fanout: int, seed: int) -> DataFrame:
    """views: observer, id, addr, state, incarnation. Each observer bumps itself and sends its view to `fanout` random alive peers."""
    bumped = bump(views, F.col("observer"))
    pick = Window.partitionBy("observer").orderBy(_order(seed, "observer", "id"))
    peers = bumped.where((F.col("state") == ALIVE) & (F.col("id") != F.col("observer"))).withColumn("n", F.row_number().over(pick)).where(F.col("n") <= fanout)
    sent = bumped.join(peers.select("observer", F.col("id").alias("to")), "observer").select(F.col("to").alias("observer"), "id", "addr", "state", "incarnation")
    every = bumped.select("observer", "id", "addr", "state", "incarnation").union(sent)
    top = F.max(F.struct("incarnation", "state", "addr")).alias("t")
    out = every.groupBy("observer", "id").agg(top).select("observer", "id", F.col("t.addr").alias("addr"), F.col("t.state").alias("state"), F.col("t.incarnation").alias("incarnation"))
    lie = (F.col("observer") == F.col("id")) & (F.col("state") != ALIVE)
    return out.withColumns({"incarnation": F.when(lie, F.col("incarnation") + 1).otherwise(F.col("incarnation")), "state": F.when(lie, ALIVE).otherwise(F.col("state")).cast("int")})


def pick_peers(members: DataFrame, self_id: str, k: int, seed: int) -> DataFrame:
    """k alive members other than self; the seed decides which."""
    return alive(members).where(F.col("id") != self_id).orderBy(_order(seed, "id")).limit(k)
