"""Tables of the engine, derived from the driver's parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = ("n0", "n1", "n2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_commands(events: DataFrame) -> DataFrame:
    """seq, ts, key, op, value, ttl_s, coord of a table of events."""
    op = F.when(F.col("event_type").isin("view", "click"), "GET").when(F.col("event_type").isin("purchase", "signup"), "SET").otherwise("DEL")
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        op.alias("op"),
        "value",
        (F.get_json_object("props", "$.k").cast("bigint") * 60).alias("ttl_s"),
        F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("coord"),
    )


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_commands(table(spark, sf_dir, "events"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's SET and DEL commands; the filter is on the stored column, so that it reaches the scan."""
    e = table(spark, sf_dir, "events")
    return as_commands(e.where(F.col("event_type").isNull() | ~F.col("event_type").isin("view", "click")))


def visible(seq, observer: int):
    """Whether a write has reached an observer."""
    return (F.floor(seq / 3) + observer) % 3 != 0


def versions(log: DataFrame) -> DataFrame:
    """seq, ts, key, coord, value, deleted, clock of every write; a clock holds what its coordinator had seen by then."""
    writes_ = log.where(F.col("op") != "GET")
    by_key = Window.partitionBy("key").orderBy("ts", "seq")  # one shuffle and one sort serve all of these
    upto, before = by_key.rowsBetween(Window.unboundedPreceding, 0), by_key.rowsBetween(Window.unboundedPreceding, -1)
    counts = {f"k{m}": F.count_if(F.col("coord") == n).over(upto) for m, n in enumerate(NODES)}
    own = F.coalesce(*[F.when(F.col("coord") == n, F.col(f"k{m}")) for m, n in enumerate(NODES)])
    writes_ = writes_.withColumns(counts).withColumn("own", own)
    seen = {(o, m): F.when((F.col("coord") == NODES[m]) & visible(F.col("seq"), o), F.col("own")) for o in range(3) for m in range(3) if o != m}
    writes_ = writes_.withColumns({f"s{o}{m}": F.max(x).over(before) for (o, m), x in seen.items()})
    clock = None
    for o in range(3):
        entries = F.array(*[F.struct(F.lit(NODES[m]).alias("key"), (F.col("own") if m == o else F.col(f"s{o}{m}")).alias("value")) for m in range(3)])
        mine = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        clock = F.when(F.col("coord") == NODES[o], mine) if clock is None else clock.when(F.col("coord") == NODES[o], mine)
    return writes_.select("seq", "ts", "key", "coord", "value", (F.col("op") == "DEL").alias("deleted"), clock.alias("clock"))


def replica_versions(vs: DataFrame) -> DataFrame:
    """A row per replica that holds a version: its own ones and those that have reached it."""
    held = F.array(*[F.when((F.col("coord") == n) | visible(F.col("seq"), o), F.lit(n)) for o, n in enumerate(NODES)])
    return vs.withColumn("replica", F.explode(F.array_compact(held)))


def ring_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([("",), ("clé-é",), ("键",)], "key string")
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")).union(fixed)


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reporters' claims about each member, in the order they arrive."""
    s = table(spark, sf_dir, "supplier")
    r = F.col("reporter")
    return s.withColumn("reporter", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        r,
        F.col("s_name").alias("id"),
        F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 250).cast("string"), F.lit(":"), (r + 7000).cast("string")).alias("addr"),
        ((F.col("s_suppkey") + r * 2) % 3).cast("int").alias("state"),
        ((F.col("s_suppkey") * 7 + r * 3) % 5).cast("bigint").alias("incarnation"),
        (F.col("s_suppkey") * 10 + r).cast("bigint").alias("arrival"),
    )


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the orders: B has altered and lost some."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    a = o.select(F.concat(F.lit("order:"), k.cast("string")).alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("blob"), k.alias("n"))
    b = a.where("n % 193 <> 0").withColumn("blob", F.when(F.col("n") % 97 == 0, F.concat("blob", F.lit("|x"))).otherwise(F.col("blob")))
    return a.drop("n"), b.drop("n")
