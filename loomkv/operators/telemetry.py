"""Counters, outcomes, bucketed latencies and their quantiles, and the rendered report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

US = 1000
#: Upper bounds in nanoseconds: 250 ns to 500 ms.
BOUNDS = [250, 500, US, 2500, 5 * US, 10 * US, 25 * US, 50 * US, 100 * US, 250 * US, 500 * US, 1000 * US, 5000 * US, 25_000 * US, 100_000 * US, 500_000 * US]


def outcome(op: Column, is_error: Column, hit: Column) -> Column:
    """error, or for GET hit or miss, or ok; a redirect has none."""
    return F.when(is_error, "error").when((op == "GET") & hit, "hit").when(op == "GET", "miss").otherwise("ok")


def counters(served: DataFrame) -> DataFrame:
    """Per command: total, hits, misses, errors; redirects (a null outcome) count in the total alone."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    return served.groupBy("command").agg(F.count("*").alias("total"), count("hit").alias("hits"), count("miss").alias("misses"), count("error").alias("errors"))


def bucket(ns: Column, bounds: list[int]) -> Column:
    """Number of the first bound at or above it; len(bounds) for the overflow."""
    out = F.when(ns <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(ns <= b, i)
    return out.otherwise(len(bounds))


def histogram(latencies: DataFrame, bounds: list[int] = BOUNDS) -> DataFrame:
    """command, bucket, n, sum_ns."""
    return latencies.groupBy("command", bucket(F.col("ns"), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.sum("ns").alias("sum_ns"))


def quantiles(hist: DataFrame, qs: list[float], bounds: list[int] = BOUNDS) -> DataFrame:
    """command, q, ns: the bound of the bucket in which the running count reaches the rank; the overflow gives the largest bound."""
    running = F.sum("n").over(Window.partitionBy("command").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("n").over(Window.partitionBy("command"))
    at = hist.withColumns({"upto": running, "whole": whole}).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    bound = F.get(F.array(*[F.lit(b).cast("bigint") for b in [*bounds, bounds[-1]]]), F.col("bucket"))
    return at.where(F.col("upto") >= F.col("q") * F.col("whole")).groupBy("command", "q").agg(F.min(bound).alias("ns"))


def events(spark: SparkSession, seen: DataFrame, registered: list[str]) -> DataFrame:
    """Counts of registered events, zeros included; others are dropped."""
    names = spark.createDataFrame([(n,) for n in registered], "event string")
    return F.broadcast(names).join(seen.groupBy("event").agg(F.count("*").alias("n")), "event", "left").select("event", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def report(counted: DataFrame, quantiles_: DataFrame, gauges: DataFrame, events_: DataFrame) -> DataFrame:
    """ord, line: a line per command, then one per gauge, then one per event."""
    wide = quantiles_.groupBy("command").agg(F.max(F.when(F.col("q") == 0.5, F.col("ns"))).alias("p50"), F.max(F.when(F.col("q") == 0.99, F.col("ns"))).alias("p99"))
    rows = counted.join(wide, "command", "left").select(
        F.concat(F.lit("0 "), "command").alias("ord"),
        F.format_string("%s total=%d hits=%d misses=%d errors=%d p50=%dns p99=%dns", "command", "total", "hits", "misses", "errors", F.coalesce("p50", F.lit(0)), F.coalesce("p99", F.lit(0))).alias("line"),
    )
    rows = rows.union(gauges.select(F.concat(F.lit("1 "), "gauge").alias("ord"), F.format_string("%s:%d", "gauge", "n").alias("line")))
    return rows.union(events_.select(F.concat(F.lit("2 "), "event").alias("ord"), F.format_string("%s:%d", "event", "n").alias("line")))
