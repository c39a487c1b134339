"""A key/value table over DataFrames: each method returns a new table and, where there is one, the operation's result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkv.operators import store


@dataclass(frozen=True)
class KeyValueTable:
    """entries: key, value, expires_at (null: never). now: the moment at which everything is looked at."""

    entries: DataFrame
    now: Column
    max_key: int = store.MAX_KEY
    max_value: int = store.MAX_VALUE

    @property
    def _live(self) -> Column:
        return ~store.expired(F.col("expires_at"), self.now)

    def range(self) -> DataFrame:
        """Live entries."""
        return self.entries.where(self._live)

    def size(self) -> DataFrame:
        """One row: n, with what is expired and still there."""
        return self.entries.agg(F.count("*").alias("n"))

    def get(self, keys: DataFrame) -> DataFrame:
        return store.get(keys, self.range())

    def _put(self, rows: DataFrame, expires_at: Column) -> tuple[KeyValueTable, DataFrame]:
        status = rows.withColumn("status", store.validate(F.col("key"), F.col("value"), self.max_key, self.max_value))
        good = status.where("status = 'ok'").select("key", "value", expires_at.cast("timestamp").alias("expires_at"))
        kept = self.entries.select("key", "value", F.col("expires_at").cast("timestamp").alias("expires_at")).join(good.select("key"), "key", "left_anti")
        return replace(self, entries=kept.unionByName(good)), status.select("key", "status")

    def set(self, rows: DataFrame) -> tuple[KeyValueTable, DataFrame]:
        """Rows of key, value, with one row per key; a former expiry is cleared. Also each key's status."""
        return self._put(rows, F.lit(None))

    def set_with_ttl(self, rows: DataFrame) -> tuple[KeyValueTable, DataFrame]:
        """Rows of key, value, ttl_ms; a ttl that isn't positive is refused and stores nothing."""
        bad = rows.where(~F.coalesce(F.col("ttl_ms") > 0, F.lit(False))).select("key", F.lit("ErrInvalidTTL").alias("status"))
        good = rows.where(F.col("ttl_ms") > 0)
        out, status = self._put(good, self.now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_ms") / 1000))
        return out, status.union(bad)

    def update_replica(self, incoming: DataFrame, merge) -> KeyValueTable:
        """Read-modify-write of the keys of incoming (key, value): merge(old, new)."""
        return replace(self, entries=store.update(self.entries, incoming, merge))

    def delete(self, keys: DataFrame) -> tuple[KeyValueTable, DataFrame]:
        """Also which keys were there, expired ones included."""
        there = keys.join(self.entries.select("key", F.lit(True).alias("was")), "key", "left").select("key", F.coalesce("was", F.lit(False)).alias("was"))
        return replace(self, entries=store.delete(self.entries, keys)), there

    def delete_if(self, condition: Column) -> KeyValueTable:
        """Live entries that meet the condition go."""
        return replace(self, entries=store.delete_if(self.entries, self._live, condition))

    def reap(self) -> KeyValueTable:
        return replace(self, entries=self.range())
