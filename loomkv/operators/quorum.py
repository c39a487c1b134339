"""Quorum writes, deletes and reads over replicas of which some are down; repair rows and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkv.functions import clocks
from loomkv.operators import versions as V


def need(quorum: int, owners: Column) -> Column:
    return F.least(F.lit(quorum), F.size(owners))


def error(op: str, got: Column, of: Column) -> Column:
    """of: how many replicas were needed."""
    return F.format_string(f"ERR {op} quorum not met: %d of %d replicas", got, of)


def acknowledged(writes: DataFrame, quorum: int, op: str, ok: Column) -> DataFrame:
    """Adds acks and reply to writes that have owners, self and up (the nodes that are reachable); self counts as one."""
    peers = F.array_remove(F.col("owners"), F.col("self"))
    acks = 1 + F.size(F.array_intersect(peers, F.col("up")))
    needed = need(quorum, F.col("owners"))
    return writes.withColumns({"acks": acks, "reply": F.when(acks >= needed, ok).otherwise(error(op, acks, needed))})


def hints(writes: DataFrame) -> DataFrame:
    """target, key, seq of every write that a peer missed, whether or not the quorum was met."""
    missed = F.array_except(F.array_remove(F.col("owners"), F.col("self")), F.col("up"))
    return writes.withColumn("target", F.explode(missed)).select("target", "key", "seq", "value")


def pending(hints_: DataFrame) -> DataFrame:
    """One hint per target and key: the last."""
    return hints_.groupBy("target", "key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def replay(pending_: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hints that are delivered, and those that are kept."""
    return pending_.join(up, "target", "left_semi"), pending_.join(up, "target", "left_anti")


def remove_hints(pending_: DataFrame, delivered: DataFrame) -> DataFrame:
    """A hint goes only if it is still the one that was delivered."""
    return pending_.join(delivered.select("target", "key", "seq"), ["target", "key", "seq"], "left_anti")


def mint(existing: DataFrame, node: str) -> DataFrame:
    """The clock of a new write on each key: the frontier of its versions, one higher at the coordinator."""
    top = V.frontier(existing, "key").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("node", "counter"))).alias("clock"))
    return top.withColumn("clock", clocks.increment(F.col("clock"), F.lit(node)))


def read(held: DataFrame, responders: list[str]) -> DataFrame:
    """The versions that the responders' sets come to, with their place in the order of arrival.

    held: replica, key, seq, coord, value, clock, deleted. Each replica's own set counts as its survivors.
    """
    rank = F.coalesce(*[F.when(F.col("replica") == r, F.lit(i)) for i, r in enumerate(responders)])
    from_ = held.where(F.col("replica").isin(responders)).withColumn("place", rank)
    once = V.last_of_writer(from_, "key", "place")
    first = once.groupBy("key", "seq").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("coord", "value", "clock", "deleted")])
    return V.reconcile_few(first, "key")


def read_from(held: DataFrame, sets_: DataFrame) -> DataFrame:
    """The same for sets of responders that differ: sets_ has key and asked, the responders in order. Adds asked to key."""
    each = sets_.select("key", "asked", F.posexplode("asked").alias("place", "replica"))
    own = V.reconcile(held, "replica", "key").join(each, ["replica", "key"])
    first = own.groupBy("key", "asked", "seq").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("coord", "value", "clock", "deleted")])
    return V.reconcile(first, "key", "asked")


def reply(merged: DataFrame, *key: str) -> DataFrame:
    """The first live version of each key; null where only tombstones are left."""
    key = key or ("key",)
    at = F.when(~F.col("deleted"), F.struct("place", "seq"))
    out = merged.groupBy(*key).agg(F.min_by("value", at).alias("value"), F.min(at).alias("_at"))
    return out.select(*key, F.when(F.col("_at").isNotNull(), F.col("value")).alias("value"), F.col("_at.seq").alias("seq"), F.col("_at").isNotNull().alias("hit"))


def repairs(merged: DataFrame, held: DataFrame, responders: list[str]) -> DataFrame:
    """replica, key of responders whose set differs from the merged one."""
    own = V.reconcile_few(V.last_of_writer(held.where(F.col("replica").isin(responders)), "replica", "key"), "replica", "key").select("replica", "key", "seq", F.lit(1).alias("mine"))
    wanted = merged.select("key", "seq").withColumn("replica", F.explode(F.array(*map(F.lit, responders))))
    both = wanted.join(own, ["replica", "key", "seq"], "full_outer")
    return both.where(F.col("mine").isNull()).select("replica", "key").union(own.join(merged.select("key", "seq"), ["key", "seq"], "left_anti").select("replica", "key")).distinct()


def apply_remote(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """A replica's sets after one version per key was handed to it; the incoming one arrives last."""
    later = incoming.withColumn("seq", F.col("seq") + F.lit(1 << 60))
    return V.reconcile_few(held.unionByName(later), "key").withColumn("seq", F.col("seq") % (1 << 60))
