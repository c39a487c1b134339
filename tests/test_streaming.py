"""Streams give what batches give."""

import datetime as dt

from pyspark.sql import functions as F

from loomkv.operators.store import latest
from loomkv.sources.tables import as_commands
from loomkv.streaming.reconcile import fold, stream_commands, windowed_traffic
from loomkv.streaming.store import replies

START = dt.datetime(2024, 1, 1)


def events(spark, n=200):
    kinds = ["view", "purchase", "error", "signup", "click"]
    data = [(i, START + dt.timedelta(seconds=97 * i), i % 7, kinds[(i * 3) % 5], float(i), '{"k": %d}' % (i % 4 + 1)) for i in range(n)]
    return spark.createDataFrame(data, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")


def files(spark, folder):
    for k in range(4):
        events(spark).where(F.col("event_id") % 4 == k).coalesce(1).write.parquet(f"{folder}/p{k}")
    return f"{folder}/p*"


def test_fold_equals_batch(spark, tmp_path):
    df = events(spark)
    df.repartition(4, "event_id").write.parquet(str(tmp_path / "in"))
    got = fold(stream_commands(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = latest(as_commands(df))
    cols = ["key", "op", "value", "seq"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_windows(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_traffic(stream_commands(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("traffic").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from traffic").first()[0] == 200


def test_stateful_store(spark, tmp_path):
    df = events(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = replies(stream_commands(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("replies").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {r.seq: (r.hit, r.reply) for r in spark.sql("select * from replies").collect()}
    state, want = {}, {}
    for r in as_commands(df).orderBy("ts", "seq").collect():
        now = state.get(r.key)
        live = now is not None and r.ts <= now[1]
        want[r.seq] = (live, now[0] if r.op == "GET" and live else None)
        if r.op == "SET":
            state[r.key] = (r.value, r.ts + dt.timedelta(seconds=r.ttl_s))
        elif r.op == "DEL":
            state.pop(r.key, None)
    assert got == want


def test_fold_rewrites_what_a_batch_touches(spark, tmp_path):
    from loomkv.streaming.reconcile import LastWrites

    df = as_commands(events(spark))
    sink = LastWrites(str(tmp_path / "out"), buckets=8)
    parts = [df.where(F.col("seq") % 4 == k) for k in range(4)]
    for n, part in enumerate(parts):
        sink(part, n)
        sink(part, n)  # run again
    cols = ["key", "op", "value", "seq"]
    assert sorted(map(tuple, sink.table(spark).select(*cols).collect())) == sorted(map(tuple, latest(df).select(*cols).collect()))
    one = df.where(F.col("key") == "user:3").limit(1)
    sink(one.withColumn("seq", F.lit(10_000).cast("bigint")).withColumn("ts", F.lit(START + dt.timedelta(days=9))).withColumn("op", F.lit("SET")), 4)
    assert len(list((tmp_path / "out" / "v=4").glob("bucket=*"))) == 1
    assert all(len(v) <= 2 for v in sink._versions(spark).values())
    assert sink.table(spark).where("key = 'user:3'").first().seq == 10_000


def test_expired_entries_leave_the_state(spark, tmp_path):
    """Answers are the same with a watermark; the state then holds no entry that expired before it."""
    rows = [(i, START + dt.timedelta(minutes=i), f"k{i}", "SET", float(i), 60) for i in range(40)] + [(100 + i, START + dt.timedelta(hours=9, minutes=i), "last", "SET", 1.0, 60) for i in range(2)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, key string, op string, value double, ttl_s bigint")
    for k in range(3):
        df.where(F.col("seq") < 40 if k == 0 else F.col("seq") == 99 + k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    q = replies(stream, late="1 minute").writeStream.format("memory").queryName("expiring").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from expiring").first()[0] == 42
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal < 10
