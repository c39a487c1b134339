"""The table's methods, and what is kept for later."""

from pyspark.sql import functions as F

from loomkv.operators import merkle
from loomkv.operators.table import KeyValueTable


def table(spark):
    data = [("a", "1", None), ("b", "2", "2024-01-01 00:00:00"), ("c", "3", "2023-12-31 23:59:59")]
    df = spark.createDataFrame(data, "key string, value string, e string").select("key", "value", F.col("e").cast("timestamp").alias("expires_at"))
    return KeyValueTable(df, F.lit("2024-01-01 00:00:00").cast("timestamp"), max_key=4, max_value=3)


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "key string")


def names(df):
    return sorted(r.key for r in df.collect())


def test_reads(spark):
    t = table(spark)
    assert names(t.range()) == ["a", "b"] and t.size().first().n == 3
    assert {r.key: (r.reply, r.hit) for r in t.get(keys(spark, "a", "c", "z")).collect()} == {"a": ("1", True), "c": (None, False), "z": (None, False)}


def test_writes(spark):
    t = table(spark)
    new, status = t.set(spark.createDataFrame([("b", "x"), ("toolong", "x"), ("d", "much"), ("", "x")], "key string, value string"))
    assert {r.key: r.status for r in status.collect()} == {"b": "ok", "toolong": "ErrKeyTooLarge", "d": "ErrValueTooLarge", "": "ErrEmptyKey"}
    assert {r.key: r.expires_at for r in new.entries.collect()}["b"] is None and names(new.entries) == ["a", "b", "c"]
    timed, status = t.set_with_ttl(spark.createDataFrame([("a", "x", 500), ("d", "y", 0)], "key string, value string, ttl_ms bigint"))
    assert {r.key: r.status for r in status.collect()} == {"a": "ok", "d": "ErrInvalidTTL"} and names(timed.entries) == ["a", "b", "c"]
    assert {r.key: r.expires_at for r in timed.entries.collect()}["a"] is not None


def test_deletes(spark):
    t = table(spark)
    left, there = t.delete(keys(spark, "c", "z"))
    assert names(left.entries) == ["a", "b"] and {r.key: r.was for r in there.collect()} == {"c": True, "z": False}
    assert names(t.delete_if(F.col("value") >= "2").entries) == ["a", "c"]
    assert names(t.reap().entries) == ["a", "b"]
    merged = t.update_replica(spark.createDataFrame([("b", "9"), ("n", "5")], "key string, value string"), F.concat)
    assert {r.key: (r.value, r.expires_at) for r in merged.entries.collect()}["b"] == ("29", None)


def test_saved_tree(spark, tmp_path):
    tree = merkle.leaves(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, blob string"), 50)
    merkle.save(tree, str(tmp_path / "t"), 50)
    back, n = merkle.load(spark, str(tmp_path / "t"))
    assert n == 64 and merkle.diff(tree, back, 50, n).count() == 0
