"""Eviction: policies replayed in order per shard, and what can be said without a replay.

Victims of LRU and LFU are exact, not those of a random sample: the least score of all incumbents, ties by the oldest
insertion, found in constant and in logarithmic time. TinyLFU's scores change with every access of other keys, so its
victim is the weakest of five incumbents drawn at random; the draw is that of the shard's seed.
"""

from __future__ import annotations

import heapq
import random
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkv.functions.hashing import shard_of
from loomkv.operators.sketch import Sketch
from loomkv.shipping import ship

#: Incumbents that TinyLFU looks at.
SAMPLE = 5


class LRU:
    """Keys in the order of their last access."""

    def __init__(self, capacity: int, seed: int = 0):
        self.order: OrderedDict[str, None] = OrderedDict()

    def touch(self, key: str, insert: bool) -> None:
        self.order[key] = None
        self.order.move_to_end(key)

    def victim(self, newcomer: str) -> str | None:
        return next((k for k in self.order if k != newcomer), None)

    def admit(self, newcomer: str, victim: str) -> bool:
        return True

    def forget(self, key: str) -> None:
        self.order.pop(key, None)


class LFU(LRU):
    """Inserting starts at 5 again; each access adds one. A heap of (score, insertion, key), in which old entries of a key are passed over."""

    def __init__(self, capacity: int, seed: int = 0):
        self.now: dict[str, tuple[int, int, str]] = {}
        self.heap: list[tuple[int, int, str]] = []
        self.inserted = 0

    def touch(self, key: str, insert: bool) -> None:
        was = self.now.get(key)
        if was is None:
            self.inserted += 1
        entry = (5 if insert else was[0] + 1, self.inserted if was is None else was[1], key)
        self.now[key] = entry
        heapq.heappush(self.heap, entry)
        if len(self.heap) > 4 * len(self.now) + 64:
            self.heap = sorted(self.now.values())

    def victim(self, newcomer: str) -> str | None:
        aside, found = None, None
        while self.heap:
            top = self.heap[0]
            if self.now.get(top[2]) == top:
                if top[2] != newcomer:
                    found = top[2]
                    break
                aside = top
            heapq.heappop(self.heap)
        if aside is not None:
            heapq.heappush(self.heap, aside)
        return found

    def forget(self, key: str) -> None:
        self.now.pop(key, None)


class TinyLFU(LRU):
    """Scores by a sketch of all accesses; a newcomer must beat the victim."""

    def __init__(self, capacity: int, seed: int = 0):
        self.sketch, self.random = Sketch(capacity), random.Random(seed)
        self.keys: list[str] = []
        self.at: dict[str, int] = {}

    def touch(self, key: str, insert: bool) -> None:
        self.sketch.add(key)
        if key not in self.at:
            self.at[key] = len(self.keys)
            self.keys.append(key)

    def victim(self, newcomer: str) -> str | None:
        drawn = [self.keys[i] for i in self.random.sample(range(len(self.keys)), min(SAMPLE + 1, len(self.keys)))]
        return min([k for k in drawn if k != newcomer][:SAMPLE], key=self.sketch.estimate, default=None)

    def admit(self, newcomer: str, victim: str) -> bool:
        return self.sketch.estimate(newcomer) > self.sketch.estimate(victim)

    def forget(self, key: str) -> None:
        i = self.at.pop(key, None)
        if i is not None:  # the last key takes its place
            last = self.keys.pop()
            if last != key:
                self.keys[i], self.at[last] = last, i


POLICIES = {"lru": LRU, "lfu": LFU, "tinylfu": TinyLFU}


class Replay:
    """A shard's entries under a policy."""

    def __init__(self, policy: str, capacity: int, seed: int = 0):
        self.policy, self.capacity = POLICIES[policy](capacity, seed), capacity
        self.entries: set[str] = set()

    def step(self, op: str, key: str) -> tuple[str, str | None]:
        """The command's outcome and the key that was evicted or refused."""
        there = key in self.entries
        if op == "GET":
            if there:
                self.policy.touch(key, insert=False)
            return ("hit" if there else "miss"), None
        if op == "DEL":
            self.entries.discard(key)
            self.policy.forget(key)
            return ("deleted" if there else "absent"), None
        self.entries.add(key)
        self.policy.touch(key, insert=True)
        if there or not self.capacity or len(self.entries) <= self.capacity:
            return "set", None
        victim = self.policy.victim(key)
        if victim is None:
            return "set", None
        loser = victim if self.policy.admit(key, victim) else key
        self.entries.discard(loser)
        self.policy.forget(loser)
        return ("refused" if loser == key else "set"), loser


def replay(log: DataFrame, policy: str, capacity: int, shards: int) -> DataFrame:
    """seq, key, op, outcome, evicted for every command. Shards, each of which holds `capacity` entries, replay side by side, each reading its commands in order, batch by batch."""
    rows = log.select(shard_of(F.col("key"), shards).alias("shard"), "seq", "key", "op")
    ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq")

    def by_shard(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, Replay] = {}
        for b in it:  # rows come sorted, so a shard's commands keep their order across batches
            out = []
            for shard, part in b.groupby("shard", sort=False):
                if shard not in states:
                    states = {shard: Replay(policy, capacity, int(shard))}
                out += run_part(states[shard], part)
            yield pd.DataFrame(out, columns=["seq", "key", "op", "outcome", "evicted"])

    def run_part(state: Replay, part: pd.DataFrame) -> list[tuple]:
        return [(s, k, o, *state.step(o, k)) for s, k, o in zip(part["seq"], part["key"], part["op"])]

    ship(log.sparkSession)
    return ordered.mapInPandas(by_shard, "seq bigint, key string, op string, outcome string, evicted string")


def lru_resident(touches: DataFrame, capacity: int, *shard: str) -> DataFrame:
    """Keys that stay where every touch inserts: per shard the `capacity` last ones."""
    last = touches.groupBy(*shard, "key").agg(F.max("seq").alias("last_seq"))
    nth = F.row_number().over(Window.partitionBy(*shard).orderBy(F.desc("last_seq")))
    return last.withColumn("nth", nth).where(F.col("nth") <= capacity).drop("nth")


def lfu_score(log: DataFrame) -> DataFrame:
    """Per key whose last write set it: 5 and one for each GET since then."""
    write = log.where("op <> 'GET'").groupBy("key").agg(F.max("seq").alias("set_seq"), F.max_by("op", "seq").alias("last_op")).where("last_op = 'SET'")
    gets = log.where("op = 'GET'").join(write, "key").where("seq > set_seq").groupBy("key").agg(F.count("*").alias("n"))
    return write.join(gets, "key", "left").select("key", (5 + F.coalesce("n", F.lit(0))).cast("bigint").alias("score"))
