"""Key/value semantics over a log of commands: the state after it, its views, and the replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEY, MAX_VALUE = 1024, 1 << 20


def latest(log: DataFrame, *extra: str) -> DataFrame:
    """The last write of each key, with whether it set or deleted. An aggregate, so hot keys shrink before they move."""
    cols = ["op", "value", "ttl_s", "ts", "seq", *extra]
    last = F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("last")
    return log.where(F.col("op") != "GET").groupBy("key").agg(last).select("key", *[F.col(f"last.{c}").alias(c) for c in dict.fromkeys(cols)])


def expired(expires_at: Column, now: Column) -> Column:
    """Strictly after the expiry; without one, never."""
    return expires_at.isNotNull() & (now > expires_at)


def with_expiry(entries: DataFrame, every: int = 1) -> DataFrame:
    """expires_at of entries: ts + ttl_s, for sets whose seq is a multiple of `every`; others never expire."""
    at = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_s"))
    return entries.withColumn("expires_at", F.when(F.col("seq") % every == 0, at))


def present(log: DataFrame) -> DataFrame:
    """What is physically there: keys whose last write set them."""
    return latest(log).where(F.col("op") == "SET")


def as_of(log: DataFrame) -> DataFrame:
    """One row: the time of the last command, which stands for now."""
    return log.agg(F.max("ts").alias("now"))


def with_now(entries: DataFrame, now: DataFrame) -> DataFrame:
    """Adds now, as a scalar subquery: it is computed once and needs no join."""
    return entries.withColumn("now", now.select("now").scalar())


def get(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Each request's value, or null for a miss."""
    return requests.join(live.select("key", F.col("value").alias("reply"), F.lit(True).alias("_there")), "key", "left").withColumn("hit", F.col("_there").isNotNull()).drop("_there")


def delete(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys, "key", "left_anti")


def delete_if(entries: DataFrame, live: Column, wanted: Column) -> DataFrame:
    """Entries that stay: those that aren't live, or for which the condition isn't true."""
    return entries.where(~F.coalesce(live & wanted, F.lit(False)))


def update(entries: DataFrame, incoming: DataFrame, merge) -> DataFrame:
    """Read-modify-write per key: merge(old, new) for keys in both; the expiry of what is written is cleared."""
    both = entries.select("key", F.col("value").alias("_old"), "expires_at").join(incoming.select("key", F.col("value").alias("_new")), "key", "full_outer")
    value = F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("_old").isNull(), F.col("_new")).otherwise(merge(F.col("_old"), F.col("_new")))
    return both.select("key", value.alias("value"), F.when(F.col("_new").isNull(), F.col("expires_at")).alias("expires_at"))


def validate(key: Column, value: Column, max_key: int = MAX_KEY, max_value: int = MAX_VALUE) -> Column:
    """The first rule that is broken, or ok. Limits are in bytes and themselves allowed; 0 lifts a limit."""
    out = F.when(F.octet_length(key) == 0, "ErrEmptyKey")
    if max_key:
        out = out.when(F.octet_length(key) > max_key, "ErrKeyTooLarge")
    if max_value:
        out = out.when(F.octet_length(value) > max_value, "ErrValueTooLarge")
    return out.otherwise("ok")


def set_status(args: Column) -> Column:
    """STRUCT<status, ttl_ms> of SET's ARRAY<STRING> of arguments: key, value, and perhaps EX seconds or PX milliseconds."""
    n, unit = F.get(args, F.lit(3)).try_cast("bigint"), F.upper(F.get(args, F.lit(2)))
    ms = F.when(unit == "EX", n * 1000).when(unit == "PX", n)
    status = (
        F.when((F.size(args) < 2) | (F.size(args) > 4), "ERR wrong number of arguments for 'SET'")
        .when(F.size(args) == 3, "ERR syntax error")
        .when((F.size(args) == 4) & n.isNull(), "ERR value is not an integer or out of range")
        .when((F.size(args) == 4) & ms.isNull(), "ERR syntax error")
        .when((F.size(args) == 4) & (ms <= 0), "ERR invalid ttl")
        .otherwise("OK")
    )
    return F.struct(status.alias("status"), F.when((F.size(args) == 4) & (ms > 0), ms).alias("ttl_ms"))
