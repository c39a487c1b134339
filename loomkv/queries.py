"""Registered queries: each operator applied to the tables derived from the driver's data, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkv import oracle as O
from loomkv.functions import clocks, hashing, resp
from loomkv.operators import eviction, membership, merkle, quorum, ring, sketch, store, telemetry
from loomkv.operators import versions as V
from loomkv.plans import antientropy, dispatch
from loomkv.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return register


# --- store


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entries with an expiry on every second one, and the time of the last command."""
    return store.with_expiry(store.present(T.writes(spark, sf)), every=2), store.as_of(T.command_log(spark, sf))


def _live(spark: SparkSession, sf: str) -> DataFrame:
    entries, now = _stored(spark, sf)
    return store.with_now(entries, now).where(~store.expired(F.col("expires_at"), F.col("now")))


@query(f"WITH {O.COMMANDS} SELECT key, value, seq FROM last_write WHERE op = 'SET'")
def kv_get_latest(spark, sf):
    return store.present(T.writes(spark, sf)).select("key", "value", "seq")


@query(f"WITH {O.COMMANDS} SELECT key, value, seq FROM stored, clock_now WHERE expires_at IS NULL OR now <= expires_at")
def kv_scan_live(spark, sf):
    return _live(spark, sf).select("key", "value", "seq")


@query(f"WITH {O.COMMANDS} SELECT count(*) AS n FROM stored")
def kv_size_physical(spark, sf):
    return _stored(spark, sf)[0].agg(F.count("*").alias("n"))


@query(f"WITH {O.COMMANDS} SELECT key, seq, CAST(date_diff('microsecond', now, ts + to_seconds(ttl_s)) AS BIGINT) AS left_us FROM last_write, clock_now WHERE op = 'SET' AND now <= ts + to_seconds(ttl_s)")
def kv_ttl_live(spark, sf):
    entries = store.with_now(store.with_expiry(store.present(T.writes(spark, sf))), store.as_of(T.command_log(spark, sf)))
    left = F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(F.col("now").cast("timestamp"))
    return entries.where(~store.expired(F.col("expires_at"), F.col("now"))).select("key", "seq", left.alias("left_us"))


@query(f"WITH {O.COMMANDS} SELECT count(*) FILTER (expires_at < now) AS removed, count(*) FILTER (expires_at IS NULL OR expires_at >= now) AS n_left FROM stored, clock_now")
def kv_reap_expired(spark, sf):
    entries, now = _stored(spark, sf)
    gone = store.expired(F.col("expires_at"), F.col("now"))
    return store.with_now(entries, now).agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("n_left"))


@query(f"WITH {O.COMMANDS} SELECT seq, key, op, CASE WHEN op = 'GET' THEN hit_value END AS reply, op = 'GET' AND hit_value IS NOT NULL AS hit FROM (SELECT c.seq, c.key, c.op, s.value AS hit_value FROM command_log c LEFT JOIN (SELECT key, value FROM stored, clock_now WHERE expires_at IS NULL OR now <= expires_at) s USING (key)) WHERE op = 'GET'")
def kv_get(spark, sf):
    requests = T.command_log(spark, sf).where("op = 'GET'").select("seq", "key", "op")
    return store.get(requests, _live(spark, sf)).select("seq", "key", "op", "reply", "hit")


@query(f"WITH {O.COMMANDS} SELECT key, value, seq FROM stored WHERE key NOT IN (SELECT key FROM command_log WHERE op = 'DEL' AND ttl_s > 5400)")
def kv_delete(spark, sf):
    """A delete request of some keys: those with a DEL of ttl_s > 5400, not of every DEL in the log. The operator takes any set of keys; the SQL names the same subset, so that it shows the operator and not the log's whole replay."""
    gone = T.command_log(spark, sf).where("op = 'DEL' and ttl_s > 5400").select("key")
    return store.delete(_stored(spark, sf)[0], gone).select("key", "value", "seq")


@query(f"WITH {O.COMMANDS} SELECT key, value, seq FROM stored, clock_now WHERE NOT ((expires_at IS NULL OR now <= expires_at) AND value > 50)")
def kv_delete_if(spark, sf):
    entries, now = _stored(spark, sf)
    live = ~store.expired(F.col("expires_at"), F.col("now"))
    return store.delete_if(store.with_now(entries, now), live, F.col("value") > 50).select("key", "value", "seq")


@query(f"WITH {O.COMMANDS}, half AS (SELECT key, max(value) AS v FROM command_log WHERE op = 'SET' AND coord = 'n0' GROUP BY key) SELECT coalesce(s.key, h.key) AS key, greatest(s.value, h.v) AS value, h.key IS NULL AND s.expires_at IS NOT NULL AS has_expiry FROM stored s FULL JOIN half h ON s.key = h.key")
def kv_update_replica(spark, sf):
    """The table merged with what one coordinator took: the SETs of n0, which is every event_id divisible by three, so a third of the log's. A merge's input is one peer's entries; the SQL names the same one."""
    incoming = T.command_log(spark, sf).where("op = 'SET' and coord = 'n0'").groupBy("key").agg(F.max("value").alias("value"))
    out = store.update(_stored(spark, sf)[0], incoming, F.greatest)
    return out.select("key", "value", F.col("expires_at").isNotNull().alias("has_expiry"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'ErrEmptyKey' WHEN octet_length(encode(c_name)) > 17 THEN 'ErrKeyTooLarge' WHEN octet_length(encode(c_mktsegment)) > 9 THEN 'ErrValueTooLarge' ELSE 'ok' END AS status FROM customer")
def kv_validate(spark, sf):
    c = T.table(spark, sf, "customer")
    key = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name"))
    return c.select("c_custkey", store.validate(key, F.col("c_mktsegment"), max_key=17, max_value=9).alias("status"))


_SET_ARGS = [["k"], ["k", "v"], ["k", "v", "EX"], ["k", "v", "EX", "100"], ["k", "v", "px", "5000"], ["k", "v", "PX", "abc"], ["k", "v", "XY", "100"], ["k", "v", "PX", "0"], ["k", "v", "EX", "-5"], ["k", "v", "EX", "1", "2"]]


@query(
    "SELECT event_id AS seq, CASE event_id % 10 WHEN 0 THEN 'ERR wrong number of arguments for ''SET''' WHEN 9 THEN 'ERR wrong number of arguments for ''SET''' WHEN 2 THEN 'ERR syntax error' WHEN 5 THEN 'ERR value is not an integer or out of range' WHEN 6 THEN 'ERR syntax error' WHEN 7 THEN 'ERR invalid ttl' WHEN 8 THEN 'ERR invalid ttl' ELSE 'OK' END AS status, CASE event_id % 10 WHEN 3 THEN 100000 WHEN 4 THEN 5000 END::BIGINT AS ttl_ms FROM events"
)
def kv_set_status(spark, sf):
    kinds = F.array(*[F.array(*map(F.lit, a)) for a in _SET_ARGS])
    args = F.get(kinds, (F.col("event_id") % 10).cast("int"))
    return T.table(spark, sf, "events").select(F.col("event_id").alias("seq"), store.set_status(args).alias("s")).select("seq", "s.status", "s.ttl_ms")


# --- clocks and versions


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Clocks of successive versions of a key."""
    vs = T.versions(T.writes(spark, sf))
    w = Window.partitionBy("key").orderBy("ts", "seq")
    return vs.select("key", "seq", F.lag("clock").over(w).alias("a"), F.col("clock").alias("b")).where("a is not null")


_PAIRS = f"WITH {O.VERSIONS}, p AS (SELECT key, seq, c0, c1, c2, lag(c0) OVER k AS a0, lag(c1) OVER k AS a1, lag(c2) OVER k AS a2 FROM ver WINDOW k AS (PARTITION BY key ORDER BY ts, seq)), pair AS (SELECT * FROM p WHERE a0 IS NOT NULL)"


@query(f"{_PAIRS} SELECT key, seq, CASE WHEN up AND down THEN 'Concurrent' WHEN up THEN 'After' WHEN down THEN 'Before' ELSE 'Equal' END AS causal FROM (SELECT *, a0 > c0 OR a1 > c1 OR a2 > c2 AS up, c0 > a0 OR c1 > a1 OR c2 > a2 AS down FROM pair)")
def vc_compare(spark, sf):
    return _pairs(spark, sf).select("key", "seq", clocks.compare(F.col("a"), F.col("b")).alias("causal"))


def _long(df: DataFrame, clock: str = "clock") -> DataFrame:
    return df.select("key", "seq", F.explode(clock).alias("node", "counter")).where("counter > 0")


_UNPIVOT = "SELECT key, seq, 'n0' AS node, x0::BIGINT AS counter FROM m WHERE x0 > 0 UNION ALL SELECT key, seq, 'n1', x1::BIGINT FROM m WHERE x1 > 0 UNION ALL SELECT key, seq, 'n2', x2::BIGINT FROM m WHERE x2 > 0"


@query(f"{_PAIRS}, m AS (SELECT key, seq, greatest(a0, c0) AS x0, greatest(a1, c1) AS x1, greatest(a2, c2) AS x2 FROM pair) {_UNPIVOT}")
def vc_merge(spark, sf):
    return _long(_pairs(spark, sf).select("key", "seq", clocks.merge(F.col("a"), F.col("b")).alias("clock")))


@query(f"WITH {O.VERSIONS}, m AS (SELECT key, seq, c0 + (coord = 'n0')::INT AS x0, c1 + (coord = 'n1')::INT AS x1, c2 + (coord = 'n2')::INT AS x2 FROM ver) {_UNPIVOT}")
def vc_increment(spark, sf):
    vs = T.versions(T.writes(spark, sf))
    return _long(vs.select("key", "seq", clocks.increment(F.col("clock"), F.col("coord")).alias("clock")))


@query(f"WITH {O.VERSIONS} SELECT key, node, max(counter)::BIGINT AS counter FROM (SELECT key, 'n0' AS node, c0 AS counter FROM ver UNION ALL SELECT key, 'n1', c1 FROM ver UNION ALL SELECT key, 'n2', c2 FROM ver) WHERE counter > 0 GROUP BY key, node")
def vc_frontier(spark, sf):
    return V.frontier(T.versions(T.writes(spark, sf)), "key")


@query(f"WITH {O.VERSIONS}, m AS (SELECT key, 0::BIGINT AS seq, max(c0) + 1 AS x0, max(c1) AS x1, max(c2) AS x2 FROM ver GROUP BY key) {_UNPIVOT}")
def vc_mint(spark, sf):
    minted = quorum.mint(T.versions(T.writes(spark, sf)), "n0")
    return _long(minted.withColumn("seq", F.lit(0).cast("bigint")))


def _siblings(spark: SparkSession, sf: str) -> DataFrame:
    return V.reconcile_few(V.last_of_writer(T.versions(T.writes(spark, sf)), "key"), "key")


@query(f"WITH {O.SURVIVORS} SELECT key, seq, coord, deleted FROM sib")
def ver_reconcile(spark, sf):
    return _siblings(spark, sf).select("key", "seq", "coord", "deleted")


@query(
    f"WITH {O.COMMANDS}, ver AS (SELECT seq, key, (seq * 7919) % 5 AS c0, (seq * 104729) % 7 AS c1, (seq // 3) % 4 AS c2 FROM command_log WHERE op <> 'GET') SELECT key, seq FROM ver v WHERE NOT EXISTS (SELECT 1 FROM ver x WHERE x.key = v.key AND ({O.dominates('x', 'v')} OR (x.c0 = v.c0 AND x.c1 = v.c1 AND x.c2 = v.c2 AND x.seq < v.seq)))"
)
def ver_reconcile_any(spark, sf):
    """Of versions whose writers' clocks don't grow, many of them concurrent or equal."""
    clock = F.create_map(F.lit("n0"), F.expr("(seq * 7919) % 5"), F.lit("n1"), F.expr("(seq * 104729) % 7"), F.lit("n2"), F.expr("(seq div 3) % 4"))
    return V.reconcile(T.writes(spark, sf).select("key", "seq", clock.alias("clock")), "key").select("key", "seq")


@query(f"WITH {O.SURVIVORS} SELECT key, seq, value FROM sib WHERE NOT deleted")
def ver_live(spark, sf):
    return V.live(_siblings(spark, sf)).select("key", "seq", "value")


@query(
    f"WITH {O.HELD}, s AS (SELECT key, list(seq ORDER BY seq) FILTER (replica = 'n0') AS a, list(seq ORDER BY seq) FILTER (replica = 'n1') AS b FROM own_set GROUP BY key) SELECT key, a IS NOT DISTINCT FROM b AS same FROM s"
)
def ver_equal(spark, sf):
    held = T.replica_versions(T.versions(T.writes(spark, sf)))
    own = V.reconcile_few(V.last_of_writer(held, "replica", "key"), "replica", "key")
    return V.equal(own.where("replica = 'n0'"), own.where("replica = 'n1'"), "key")


def _aged(spark: SparkSession, sf: str) -> DataFrame:
    """Siblings with the second of their tombstone, and now."""
    log = T.command_log(spark, sf)
    sib = V.reconcile_few(V.last_of_writer(T.versions(T.writes(spark, sf)), "key"), "key").withColumn("deleted_at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return store.with_now(sib, log.agg(F.max(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("now")))


_REAP = f"WITH {O.SURVIVORS}, reap AS (SELECT key, bool_and(deleted AND (SELECT max(epoch_us(ts) // 1000000) FROM command_log) - epoch_us(ts) // 1000000 > 3600) AS reapable FROM sib GROUP BY key)"


@query(f"{_REAP} SELECT key, reapable FROM reap")
def tombstone_reapable(spark, sf):
    return _aged(spark, sf).groupBy("key").agg(V.reapable(F.col("now"), 3600).alias("reapable"))


@query(f"{_REAP} SELECT key, seq, deleted FROM sib WHERE key NOT IN (SELECT key FROM reap WHERE reapable)")
def tombstone_sweep(spark, sf):
    aged = _aged(spark, sf)
    gone = aged.groupBy("key").agg(V.reapable(F.col("now"), 3600).alias("r")).where("r").select("key")
    return store.delete(aged, gone).select("key", "seq", "deleted")


# --- placement

NODES = [f"n{i}" for i in range(5)]


@query(f"WITH {O.RING} SELECT key, CAST(CASE WHEN u < 0 THEN u + 9223372036854775808::HUGEINT ELSE u - 9223372036854775808::HUGEINT END AS BIGINT) AS h FROM hashed")
def fnv1a_hash(spark, sf):
    return T.ring_keys(spark, sf).select("key", hashing.fnv1a64(F.col("key")).alias("h"))


@query(f"WITH {O.RING} SELECT key, owner FROM {O.owned()}")
def ring_owner(spark, sf):
    return ring.owner(T.ring_keys(spark, sf), ring.points(spark, NODES))


@query(f"WITH {O.RING}, {O.WALK} SELECT key, CAST(n AS INTEGER) AS place, node FROM nth WHERE n <= 3")
def ring_replicas(spark, sf):
    found = ring.owners(T.ring_keys(spark, sf), ring.points(spark, NODES), 3)
    return found.select("key", F.posexplode("owners").alias("place", "node")).select("key", (F.col("place") + 1).alias("place"), "node")


@query(f"WITH {O.RING} SELECT owner, count(*) AS n FROM {O.owned()} GROUP BY owner")
def ring_load(spark, sf):
    return ring.owner(T.ring_keys(spark, sf), ring.points(spark, NODES)).groupBy("owner").agg(F.count("*").alias("n"))


@query(f"WITH {O.RING} SELECT a.key, a.owner AS was, b.owner AS now FROM {O.owned()} a JOIN {O.owned('node <> $$n2$$')} b ON a.key = b.key WHERE a.owner <> b.owner")
def ring_remap_on_remove(spark, sf):
    keys, points = T.ring_keys(spark, sf), ring.points(spark, NODES)
    a, b = ring.owner(keys, points).withColumnRenamed("owner", "was"), ring.owner(keys, ring.remove(points, "n2")).withColumnRenamed("owner", "now")
    return a.join(b, "key").where("was <> now")


@query(f"WITH {O.RING} SELECT key, CASE WHEN owner = 'n0' THEN 'LOCAL' ELSE 'MOVED ' || owner END AS reply FROM {O.owned()}")
def route_moved(spark, sf):
    return ring.owner(T.ring_keys(spark, sf), ring.points(spark, NODES)).select("key", ring.route(F.col("owner"), "n0").alias("reply"))


@query(f"WITH {O.RING}, {O.WALK} SELECT key, node AS peer FROM nth WHERE n <= 3 AND node <> 'n0'")
def ring_peers(spark, sf):
    found = ring.owners(T.ring_keys(spark, sf), ring.points(spark, NODES), 3)
    return found.select("key", F.explode(ring.peers_except(F.col("owners"), "n0")).alias("peer"))


@query(f"WITH {O.RING} SELECT count(*) FILTER (owner = 'n0') AS here, count(*) AS n FROM {O.owned()}")
def ring_is_local(spark, sf):
    owned = ring.owner(T.ring_keys(spark, sf), ring.points(spark, NODES))
    return owned.agg(F.count_if(ring.is_local(F.col("owner"), "n0")).alias("here"), F.count("*").alias("n"))


@query(f"WITH {O.RING} SELECT key, owner FROM {O.owned('node <> $$n1$$ AND node <> $$n3$$')}")
def ring_rebuild(spark, sf):
    """The ring of those members that are alive."""
    members = spark.createDataFrame([(n, 2 if n in ("n1", "n3") else 0) for n in NODES], "id string, state int")
    return ring.owner(T.ring_keys(spark, sf), ring.rebuild(members))


# --- quorums


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    """Writes with their replica set and the nodes that are up at that moment."""
    up = F.array_compact(F.array(*[F.when((F.floor(F.col("seq") / 7) + i) % 4 != 0, F.lit(n)) for i, n in enumerate(T.NODES)]))
    return T.writes(spark, sf).withColumns({"self": F.col("coord"), "owners": F.array(*map(F.lit, T.NODES)), "up": up})


@query(f"WITH {O.QUORUM} SELECT seq, acks, CASE WHEN acks >= 3 THEN 'OK' ELSE 'ERR write quorum not met: ' || acks || ' of 3 replicas' END AS reply FROM acked WHERE op = 'SET'")
def quorum_write(spark, sf):
    return quorum.acknowledged(_sent(spark, sf).where("op = 'SET'"), 3, "write", F.lit("OK")).select("seq", "acks", "reply")


_WAS = "(SELECT c.seq, (SELECT arg_max(x.op, struct_pack(t := x.ts, s := x.seq)) FROM command_log x WHERE x.key = c.key AND x.op <> 'GET' AND (x.ts, x.seq) < (c.ts, c.seq)) = 'SET' AS there FROM command_log c WHERE c.op = 'DEL')"


@query(f"WITH {O.QUORUM} SELECT seq, CASE WHEN acks >= 2 THEN CASE WHEN there THEN '1' ELSE '0' END ELSE 'ERR delete quorum not met: ' || acks || ' of 2 replicas' END AS reply FROM acked JOIN {_WAS} USING (seq)")
def quorum_delete(spark, sf):
    w = Window.partitionBy("key").orderBy("ts", "seq")
    sent = _sent(spark, sf).withColumn("there", F.coalesce(F.lag("op").over(w) == "SET", F.lit(False))).where("op = 'DEL'")
    return quorum.acknowledged(sent, 2, "delete", F.col("there").cast("int").cast("string")).select("seq", "reply")


def _read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    held = T.replica_versions(T.versions(T.writes(spark, sf)))
    return quorum.read(held, ["n0", "n1"]), held


@query(f"WITH {O.HELD} SELECT key, arg_min(value, struct_pack(p := place, s := seq)) FILTER (NOT deleted) AS value, min(struct_pack(p := place, s := seq)) FILTER (NOT deleted).s AS seq, bool_or(NOT deleted) AS hit FROM merged GROUP BY key")
def quorum_read(spark, sf):
    return quorum.reply(_read(spark, sf)[0])


@query(
    f"WITH {O.HELD} SELECT DISTINCT replica, key FROM (SELECT r.replica, m.key FROM merged m, (VALUES ('n0'), ('n1')) r(replica) WHERE NOT EXISTS (SELECT 1 FROM own_set o WHERE o.replica = r.replica AND o.key = m.key AND o.seq = m.seq) UNION ALL SELECT replica, key FROM own_set o WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.key = o.key AND m.seq = o.seq))"
)
def read_repair(spark, sf):
    merged, held = _read(spark, sf)
    return quorum.repairs(merged, held, ["n0", "n1"])


@query(f"WITH {O.QUORUM} SELECT target, key, seq FROM waiting")
def hints_pending(spark, sf):
    return quorum.pending(quorum.hints(_sent(spark, sf))).select("target", "key", "seq")


@query(f"WITH {O.QUORUM} SELECT target, CASE WHEN target <> 'n2' THEN 'delivered' ELSE 'kept' END AS state, count(*) AS n FROM waiting GROUP BY ALL")
def hint_replay(spark, sf):
    up = spark.createDataFrame([("n0",), ("n1",)], "target string")
    done, kept = quorum.replay(quorum.pending(quorum.hints(_sent(spark, sf))), up)
    return done.withColumn("state", F.lit("delivered")).union(kept.withColumn("state", F.lit("kept"))).groupBy("target", "state").agg(F.count("*").alias("n"))


@query(f"WITH {O.QUORUM} SELECT target, key, seq FROM waiting WHERE NOT (target = 'n0' AND seq % 2 = 0)")
def hints_remove(spark, sf):
    """Deliveries of even hints to n0 are confirmed; of odd ones the hint is newer than what was delivered."""
    waiting = quorum.pending(quorum.hints(_sent(spark, sf)))
    delivered = waiting.where("target = 'n0'").withColumn("seq", F.col("seq") - F.col("seq") % 2)
    return quorum.remove_hints(waiting, delivered).select("target", "key", "seq")


@query(f"WITH {O.HELD}, a AS (SELECT * FROM own_set WHERE replica = 'n0'), t AS (SELECT max(seq) AS seq FROM ver WHERE coord = 'n2' GROUP BY key), i AS (SELECT * FROM ver WHERE seq IN (SELECT seq FROM t)), u AS (SELECT key, seq, c0, c1, c2, 0 AS late FROM a UNION SELECT key, seq, c0, c1, c2, 1 FROM i) SELECT key, seq FROM u v WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.key = v.key AND ((x.c0 >= v.c0 AND x.c1 >= v.c1 AND x.c2 >= v.c2 AND (x.c0 > v.c0 OR x.c1 > v.c1 OR x.c2 > v.c2)) OR (x.seq = v.seq AND x.late < v.late)))")
def replica_set(spark, sf):
    """n0 is handed the last version that n2 wrote of each key."""
    vs = T.versions(T.writes(spark, sf))
    held = V.reconcile_few(V.last_of_writer(T.replica_versions(vs).where("replica = 'n0'").drop("replica"), "key"), "key")
    incoming = V.last_of_writer(vs.where("coord = 'n2'"), "key").select(*held.columns)
    return quorum.apply_remote(held, incoming).select("key", "seq")


@query(f"WITH {O.HELD} SELECT replica, key, seq, deleted FROM own_set")
def replica_get(spark, sf):
    """What each of two replicas holds, without routing."""
    held = T.replica_versions(T.versions(T.writes(spark, sf))).where("replica in ('n0', 'n1')")
    return V.reconcile_few(V.last_of_writer(held, "replica", "key"), "replica", "key").select("replica", "key", "seq", "deleted")


# --- anti-entropy


@query(f"WITH {O.STORES} SELECT key, CAST('0x' || substr(sha256(key), 14, 3) AS INTEGER) & 1023 AS bucket FROM store_a")
def merkle_bucket(spark, sf):
    return T.stores(spark, sf)[0].select("key", hashing.merkle_bucket(F.col("key"), 1024).alias("bucket"))


@query(f"WITH {O.STORES} SELECT * FROM {O.leaves('store_a')}")
def merkle_leaves(spark, sf):
    return merkle.leaves(T.stores(spark, sf)[0])


@query(O.merkle_root())
def merkle_root(spark, sf):
    return merkle.root(merkle.leaves(T.stores(spark, sf)[0]))


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = T.stores(spark, sf)
    return merkle.diff(merkle.leaves(a), merkle.leaves(b))


@query(f"WITH {O.DIFF} SELECT bucket FROM differing")
def merkle_diff(spark, sf):
    return _diff(spark, sf)


@query(f"WITH {O.DIFF} SELECT key, blob FROM store_b WHERE CAST('0x' || substr(sha256(key), 14, 3) AS INTEGER) & 1023 IN (SELECT bucket FROM differing)")
def merkle_fetch(spark, sf):
    return merkle.fetch(T.stores(spark, sf)[1], _diff(spark, sf)).select("key", "blob")


def _held_by(spark: SparkSession, sf: str, *nodes: str) -> dict[str, DataFrame]:
    """Each node's sibling sets. All are derived in one pass and written, since a round reads either side twice, for its tree and for its versions."""
    from loomkv.streaming.folders import written

    held = T.replica_versions(T.versions(T.writes(spark, sf))).where(F.col("replica").isin(*nodes))
    sets = written(V.reconcile(held.select("replica", "key", "seq", "clock", "deleted", "value"), "replica", "key"))
    return {n: sets.where(F.col("replica") == n).drop("replica") for n in nodes}


@query(f"WITH {O.HELD} SELECT key, seq, deleted FROM merged")
def anti_entropy_sync(spark, sf):
    """n0 after a round with n1: concurrent versions are siblings."""
    held = _held_by(spark, sf, "n0", "n1")
    return antientropy.pull(held["n0"], held["n1"]).select("key", "seq", "deleted")


@query(f"WITH {O.HELD}, every AS (SELECT DISTINCT key, seq, deleted, c0, c1, c2 FROM held) SELECT key, seq, deleted FROM every v WHERE NOT EXISTS (SELECT 1 FROM every x WHERE x.key = v.key AND {O.dominates('x', 'v')})")
def anti_entropy_rounds(spark, sf):
    """n1 visits n2, then n0 visits n1: what n2 held reaches n0 by way of n1."""
    from loomkv.streaming.folders import written

    held = _held_by(spark, sf, "n0", "n1", "n2")
    return antientropy.rounds(held, [("n1", "n2"), ("n0", "n1")], written)["n0"].select("key", "seq", "deleted")


# --- membership


def _members(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    claims = T.roster(spark, sf)
    me = claims.agg(F.min("id")).first()[0]
    return membership.merge(claims, me), me


@query(f"WITH {O.ROSTER} SELECT id, addr, state, incarnation FROM member")
def gossip_merge(spark, sf):
    return _members(spark, sf)[0]


@query(f"WITH {O.ROSTER} SELECT id || ' ' || addr AS line FROM member WHERE state = 0")
def alive_nodes(spark, sf):
    return membership.nodes_reply(_members(spark, sf)[0])


@query(f"WITH {O.ROSTER} SELECT id, CASE WHEN state = 0 AND id NOT IN (SELECT id FROM self) AND incarnation <= 2 THEN 2 ELSE state END AS state FROM member")
def detect_failures(spark, sf):
    members, me = _members(spark, sf)
    seen = members.withColumn("last_seen", 100 + F.col("incarnation"))
    return membership.detect_failures(seen, me, F.lit(110), 7).select("id", "state")


_ACCEPTED = "rated AS (SELECT *, max(struct_pack(i := incarnation, s := state)) OVER (PARTITION BY id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM roster), ok AS (SELECT * FROM rated WHERE b IS NULL OR struct_pack(i := incarnation, s := state) > b)"


@query(f"WITH {O.ROSTER}, {_ACCEPTED} SELECT id, arrival, CASE WHEN b IS NULL THEN 'joined' WHEN state = 0 THEN 'recovered' ELSE 'changed' END AS event, b.s AS was, state AS now FROM ok WHERE b IS NULL OR b.s <> state")
def state_transitions(spark, sf):
    return membership.transitions(T.roster(spark, sf))


@query("""
WITH m AS (SELECT s_nationkey, s_suppkey // 1250 AS part, s_name AS id, '10.0.0.1:' || s_suppkey AS addr, CAST(s_suppkey % 3 AS INTEGER) AS state, s_suppkey AS incarnation FROM supplier),
v AS (SELECT o.id AS observer, m.id, m.addr, m.state, m.incarnation + CASE WHEN o.id = m.id THEN 1 ELSE 0 END AS incarnation FROM m o JOIN m USING (s_nationkey, part)),
p AS (SELECT observer, id AS dest FROM v WHERE state = 0 AND id <> observer QUALIFY row_number() OVER (PARTITION BY observer ORDER BY md5('1/' || observer || '/' || id)) <= 3),
e AS (SELECT * FROM v UNION ALL SELECT p.dest, v.id, v.addr, v.state, v.incarnation FROM v JOIN p USING (observer)),
t AS (SELECT observer, id, max(struct_pack(i := incarnation, s := state, a := addr)) AS t FROM e GROUP BY ALL)
SELECT observer, id, t.a AS addr, CASE WHEN observer = id THEN 0 ELSE t.s END AS state, t.i + CASE WHEN observer = id AND t.s <> 0 THEN 1 ELSE 0 END AS incarnation FROM t""")
def gossip_round(spark, sf):
    """Clusters of a nation's suppliers, about fifty each; every member begins with its own cluster in view."""
    s = T.table(spark, sf, "supplier")
    members = s.select("s_nationkey", F.expr("s_suppkey div 1250").alias("part"), F.col("s_name").alias("id"), F.concat(F.lit("10.0.0.1:"), "s_suppkey").alias("addr"), (F.col("s_suppkey") % 3).cast("int").alias("state"), F.col("s_suppkey").alias("incarnation"))
    views = members.select("s_nationkey", "part", F.col("id").alias("observer")).join(members, ["s_nationkey", "part"]).drop("s_nationkey", "part")
    return membership.gossip_round(spark, views, fanout=3, seed=1)


# --- telemetry


def _served(spark: SparkSession, sf: str) -> DataFrame:
    """Every command with its latency and outcome; each eleventh is redirected, each seventeenth fails."""
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when(F.col("op") != "GET", F.col("op")), ignorenulls=True).over(w) == "SET", F.lit(False))
    log = T.command_log(spark, sf).withColumn("there", there)
    outcome = F.when(F.col("seq") % 11 != 0, telemetry.outcome(F.col("op"), F.col("seq") % 17 == 0, F.col("there")))
    return log.select("seq", F.col("op").alias("command"), ((F.col("seq") * 7919) % 700000 * 1000).alias("ns"), outcome.alias("outcome"))


@query(f"WITH {O.SERVED} SELECT command, count(*) AS total, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'error') AS errors FROM served GROUP BY command")
def stats_commands(spark, sf):
    return telemetry.counters(_served(spark, sf))


@query(f"WITH {O.SERVED} SELECT seq, outcome FROM served WHERE outcome IS NOT NULL")
def stats_outcomes(spark, sf):
    return _served(spark, sf).where("outcome is not null").select("seq", "outcome")


def _hist(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.histogram(_served(spark, sf).where("outcome is not null"))


@query(f"WITH {O.SERVED} SELECT command, bucket, n, sum_ns FROM hist")
def latency_histogram(spark, sf):
    return _hist(spark, sf)


@query(f"WITH {O.SERVED} SELECT command, q, ns FROM quant")
def latency_quantiles(spark, sf):
    return telemetry.quantiles(_hist(spark, sf), [0.5, 0.95, 0.99])


@query("SELECT e AS event, count(event_id) AS n FROM (SELECT unnest(['click', 'error', 'evicted', 'signup']) AS e) LEFT JOIN events ON event_type = e GROUP BY e")
def stats_events(spark, sf):
    seen = T.table(spark, sf, "events").select(F.col("event_type").alias("event"))
    return telemetry.events(spark, seen, ["click", "error", "evicted", "signup"])


def _gauges(spark: SparkSession, sf: str) -> DataFrame:
    keys = _stored(spark, sf)[0].agg(F.count("*").alias("n")).select(F.lit("store_keys").alias("gauge"), "n")
    waiting = quorum.pending(quorum.hints(_sent(spark, sf))).agg(F.count("*").alias("n"))
    return keys.union(waiting.select(F.lit("hints_pending").alias("gauge"), "n"))


@query(f"WITH {O.QUORUM} SELECT 'store_keys' AS gauge, count(*) AS n FROM stored UNION ALL SELECT 'hints_pending', count(*) FROM waiting")
def stats_gauges(spark, sf):
    return _gauges(spark, sf)


_REPORT = "SELECT '0 ' || command AS ord, command || ' total=' || count(*) || ' hits=' || count(*) FILTER (outcome = 'hit') || ' misses=' || count(*) FILTER (outcome = 'miss') || ' errors=' || count(*) FILTER (outcome = 'error') || ' p50=' || (SELECT ns FROM quant WHERE quant.command = served.command AND q = 0.5) || 'ns p99=' || (SELECT ns FROM quant WHERE quant.command = served.command AND q = 0.99) || 'ns' AS line FROM served GROUP BY command"


def _report(spark: SparkSession, sf: str) -> DataFrame:
    gauges = _gauges(spark, sf).where("gauge = 'store_keys'")
    return telemetry.report(telemetry.counters(_served(spark, sf)), telemetry.quantiles(_hist(spark, sf), [0.5, 0.99]), gauges, stats_events(spark, sf))


_REPORT_ALL = f"{_REPORT} UNION ALL SELECT '1 store_keys', 'store_keys:' || count(*) FROM stored UNION ALL SELECT '2 ' || e, e || ':' || count(event_id) FROM (SELECT unnest(['click', 'error', 'evicted', 'signup']) AS e) LEFT JOIN events ON event_type = e GROUP BY e"


@query(f"WITH {O.SERVED} {_REPORT_ALL}")
def stats_report(spark, sf):
    return _report(spark, sf)


@query(f"WITH {O.SERVED}, r AS ({_REPORT_ALL}), t AS (SELECT 'uptime_seconds:42' || chr(13) || chr(10) || string_agg(line || chr(13) || chr(10), '' ORDER BY ord) AS x FROM r) SELECT '$' || octet_length(encode(x)) || chr(13) || chr(10) || x || chr(13) || chr(10) AS reply FROM t")
def cmd_stats(spark, sf):
    return dispatch.stats(_report(spark, sf), uptime=42)


# --- eviction


@query(f"WITH {O.COMMANDS} SELECT shard, key, last_seq FROM (SELECT CAST(CAST(substr(key, 6) AS BIGINT) % 4 AS INTEGER) AS shard, key, max(seq) AS last_seq FROM command_log GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC) <= 8")
def lru_resident(spark, sf):
    touched = T.command_log(spark, sf).withColumn("shard", (F.substring("key", 6, 20).cast("bigint") % 4).cast("int"))
    return eviction.lru_resident(touched, 8, "shard").select("shard", "key", "last_seq")


@query(f"WITH {O.COMMANDS} SELECT key, 5 + (SELECT count(*) FROM command_log g WHERE g.key = w.key AND g.op = 'GET' AND g.seq > w.seq) AS score FROM (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op FROM command_log WHERE op <> 'GET' GROUP BY key) w WHERE op = 'SET'")
def lfu_score(spark, sf):
    return eviction.lfu_score(T.command_log(spark, sf))


@query(
    f"WITH {O.COMMANDS}, per AS (SELECT key || '/' || ttl_s AS key, count(*) AS k FROM command_log GROUP BY ALL), cell AS (SELECT key, r, {O.cell('key', 1024)} AS c FROM per, range(4) t(r)), sk AS (SELECT r, c, least(15, sum(k)) AS n FROM per JOIN cell USING (key) GROUP BY r, c) SELECT key, CAST(min(coalesce(n, 0)) AS BIGINT) AS estimate FROM cell LEFT JOIN sk USING (r, c) GROUP BY key"
)
def sketch_estimate(spark, sf):
    """Of keys with their TTL, so that counters aren't all at their limit."""
    log = T.command_log(spark, sf).select(F.concat_ws("/", "key", "ttl_s").alias("key"))
    return sketch.estimate(log.select("key").distinct(), sketch.build(log, 1024), 1024)


@query(f"WITH {O.COMMANDS}, per AS (SELECT key, count(*) AS k FROM command_log GROUP BY key) SELECT CAST(r AS INTEGER) AS row, {O.cell('key', 64)} AS col, CAST(least(15, sum(k)) // 2 AS BIGINT) AS n FROM per, range(4) t(r) GROUP BY ALL")
def sketch_aged(spark, sf):
    return sketch.halve(sketch.build(T.command_log(spark, sf), 64))


@query(f"WITH {O.ROSTER} SELECT id, addr, 0 AS state, incarnation FROM member WHERE id NOT IN (SELECT id FROM self) ORDER BY md5('7/' || id) LIMIT 3")
def pick_peers(spark, sf):
    members, me = _members(spark, sf)
    return membership.pick_peers(members.withColumn("state", F.lit(0)), me, 3, seed=7)


#: Commands that one shard of a replay should have to read, in order.
SHARD_COMMANDS = 1_000_000


def _replayed(policy: str) -> Query:
    def run(spark, sf):
        log = T.command_log(spark, sf)
        return eviction.replay(log, policy, capacity=20, shards=max(4, log.count() // SHARD_COMMANDS))

    return run


for _policy in eviction.POLICIES:
    _QUERIES[f"{_policy}_replay"] = _replayed(_policy)
    if _policy != "tinylfu":  # whose victims are drawn at random
        _ORACLE[f"{_policy}_replay"] = O.replay(_policy, 20, 4)


# --- protocol


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """seq, name in any case, args; some with too few or unknown words."""
    log = T.command_log(spark, sf)
    name = F.when(F.col("seq") % 13 == 0, "NOPE").when(F.col("seq") % 2 == 0, F.lower("op")).otherwise(F.col("op"))
    value = F.concat(F.lit("v"), "seq")
    args = F.when(F.col("seq") % 19 == 0, F.array().cast("array<string>")).when(F.col("op") == "SET", F.array("key", value)).otherwise(F.array("key"))
    return log.select("seq", name.alias("name"), args.alias("args"))


_REQUEST = f"{O.COMMANDS}, req AS (SELECT seq, key, op, CASE WHEN seq % 13 = 0 THEN 'NOPE' WHEN seq % 2 = 0 THEN lower(op) ELSE op END AS name, CASE WHEN seq % 19 = 0 THEN [] WHEN op = 'SET' THEN [key, 'v' || seq] ELSE [key] END AS args FROM command_log)"
_BULK = "'$' || octet_length(encode({0})) || chr(13) || chr(10) || {0} || chr(13) || chr(10)"


@query(f"WITH {_REQUEST} SELECT seq, '*' || (len(args) + 1) || chr(13) || chr(10) || {_BULK.format('name')} || coalesce(array_to_string(list_transform(args, lambda x: {_BULK.format('x')}), ''), '') AS wire FROM req")
def resp_encode(spark, sf):
    return _requests(spark, sf).select("seq", resp.encode_command(F.col("name"), F.col("args")).alias("wire"))


@query(f"WITH {_REQUEST} SELECT seq, true AS ok, name, CAST(len(args) AS INTEGER) AS argc, args[1] AS first_arg FROM req")
def resp_parse(spark, sf):
    wires = _requests(spark, sf).select("seq", resp.encode_command(F.col("name"), F.col("args")).alias("wire"))
    parsed = wires.select("seq", resp.parse_command(F.col("wire")).alias("c"))
    return parsed.select("seq", "c.ok", "c.name", F.size("c.args").alias("argc"), F.get("c.args", F.lit(0)).alias("first_arg"))


@query(
    f"WITH {_REQUEST} SELECT seq, CASE WHEN name = 'NOPE' THEN 'ERR unknown command ''NOPE''' WHEN len(args) = 0 THEN 'ERR wrong number of arguments for ''' || name || '''' END AS error, CASE WHEN name <> 'NOPE' THEN upper(name) END AS verb FROM req"
)
def cmd_dispatch(spark, sf):
    return dispatch.analyse(_requests(spark, sf)).select("seq", "error", "verb")


@query(
    f"WITH {_REQUEST}, there AS (SELECT key, 's' || seq AS v FROM stored) SELECT seq, CASE WHEN name = 'NOPE' THEN '-ERR unknown command ''NOPE''' || chr(13) || chr(10) WHEN len(args) = 0 THEN '-ERR wrong number of arguments for ''' || name || '''' || chr(13) || chr(10) WHEN op = 'SET' THEN '+OK' || chr(13) || chr(10) WHEN op = 'DEL' THEN ':' || CASE WHEN v IS NULL THEN 0 ELSE 1 END || chr(13) || chr(10) WHEN v IS NULL THEN '$-1' || chr(13) || chr(10) ELSE {_BULK.format('v')} END AS reply FROM req LEFT JOIN there USING (key)"
)
def cmd_reply(spark, sf):
    live = _stored(spark, sf)[0].select("key", F.concat(F.lit("s"), "seq").alias("value"))
    answered = dispatch.respond(dispatch.analyse(_requests(spark, sf)), live)
    return answered.select("seq", resp.encode(F.col("reply")).alias("reply"))


_NL = "chr(13) || chr(10)"
_SERVER_ERRORS = f"CASE WHEN name = 'NOPE' THEN '-ERR unknown command ''NOPE''' || {_NL} WHEN len(args) = 0 THEN '-ERR wrong number of arguments for ''' || name || '''' || {_NL}"
_ROUTED = O.RING.replace("SELECT c_name AS key FROM customer UNION ALL SELECT unnest(['', 'clé-é', '键'])", "SELECT DISTINCT key FROM command_log").strip()


@query(f"WITH {_REQUEST}, {_ROUTED} SELECT seq, {_SERVER_ERRORS} WHEN owner <> 'n0' THEN '-MOVED ' || owner || {_NL} ELSE '' END AS reply FROM req LEFT JOIN {O.owned()} o USING (key)")
def cmd_route(spark, sf):
    """What n0 of five nodes refuses or sends elsewhere; empty where it serves the command."""
    routed = dispatch.route(dispatch.analyse(_requests(spark, sf)), ring.points(spark, NODES), "n0")
    return routed.select("seq", F.when(F.col("error").isNull(), "").otherwise(resp.encode(resp.error(F.col("error")))).alias("reply"))


@query(
    f"WITH {_REQUEST}, fine AS (SELECT seq, key, op FROM req WHERE name <> 'NOPE' AND len(args) > 0 AND op <> 'GET'), state AS (SELECT r.seq, r.key, arg_max(f.op, f.seq) AS op, max(f.seq) AS at FROM req r LEFT JOIN fine f ON f.key = r.key AND f.seq < r.seq GROUP BY r.seq, r.key), now AS (SELECT s.seq, CASE WHEN s.op = 'SET' THEN 'v' || s.at WHEN s.op IS NULL THEN t.v END AS v FROM state s LEFT JOIN (SELECT key, 's' || seq AS v FROM stored) t USING (key)) "
    f"SELECT seq, {_SERVER_ERRORS} WHEN op = 'SET' THEN '+OK' || {_NL} WHEN op = 'DEL' THEN ':' || CASE WHEN v IS NULL THEN 0 ELSE 1 END || {_NL} WHEN v IS NULL THEN '$-1' || {_NL} ELSE {_BULK.format('v')} END AS reply FROM req JOIN now USING (seq)"
)
def cmd_sequence(spark, sf):
    """Each command sees what those before it did; the entries of the snapshot stand before them all."""
    live = _stored(spark, sf)[0].select("key", F.concat(F.lit("s"), "seq").alias("value"))
    return dispatch.respond_in_order(dispatch.analyse(_requests(spark, sf)), live).select("seq", resp.encode(F.col("reply")).alias("reply"))


_UP = "list_filter(['n0', 'n1', 'n2'], lambda x: ((seq // 7) + CAST(substr(x, 2) AS BIGINT)) % 4 <> 0)"


@query(
    f"WITH {O.HELD.replace('place < 2 AND', '')}, {_REQUEST.removeprefix(O.COMMANDS).lstrip(', ')}, mine AS (SELECT seq, key, op, list_filter({_UP}, lambda x: x <> 'n0') AS peers FROM req WHERE name <> 'NOPE' AND len(args) > 0), "
    "asked AS (SELECT *, CASE WHEN len(peers) > 0 THEN ['n0', peers[1]] ELSE ['n0'] END AS asked FROM mine), "
    "sets AS (SELECT DISTINCT key, asked FROM asked WHERE op = 'GET' AND len(asked) = 2), got AS (SELECT s.key, s.asked, o.seq, min(list_position(s.asked, o.replica)) AS place, any_value(o.value) AS value, any_value(o.deleted) AS deleted, any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2 FROM sets s JOIN own_set o ON o.key = s.key AND list_contains(s.asked, o.replica) GROUP BY s.key, s.asked, o.seq), "
    f"best AS (SELECT key, asked, arg_min(seq, struct_pack(p := place, s := seq)) AS seq FROM got v WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM got x WHERE x.key = v.key AND x.asked = v.asked AND {O.dominates('x', 'v')}) GROUP BY key, asked), "
    "there AS (SELECT DISTINCT key FROM own_set WHERE replica = 'n0' AND NOT deleted) "
    "SELECT a.seq, CASE op WHEN 'SET' THEN CASE WHEN len(peers) >= 1 THEN 'OK' ELSE 'ERR write quorum not met: 1 of 2 replicas' END WHEN 'DEL' THEN CASE WHEN len(peers) < 1 THEN 'ERR delete quorum not met: 1 of 2 replicas' WHEN t.key IS NULL THEN '0' ELSE '1' END ELSE CASE WHEN len(a.asked) < 2 THEN 'ERR read quorum not met: 1 of 2 replicas' WHEN b.seq IS NULL THEN 'nil' ELSE 'w' || b.seq END END AS reply FROM asked a LEFT JOIN best b ON b.key = a.key AND b.asked = a.asked LEFT JOIN there t ON t.key = a.key"
)
def cmd_coordinate(spark, sf):
    """n0 of three nodes, which all hold every key, coordinates with two of three for reads and writes; a value names its write."""
    held = T.replica_versions(T.versions(T.writes(spark, sf))).withColumn("value", F.concat(F.lit("w"), "seq"))
    up = F.array_compact(F.array(*[F.when((F.floor(F.col("seq") / 7) + i) % 4 != 0, F.lit(n)) for i, n in enumerate(T.NODES)]))
    requests = dispatch.analyse(_requests(spark, sf)).withColumns({"up": up, "owners": F.array(*map(F.lit, T.NODES))})
    done = dispatch.coordinate(requests, held.select("replica", "key", "seq", "coord", "value", "clock", "deleted"), "n0", r=2, w=2)
    text = F.coalesce("reply.str", F.col("reply.int").cast("string"), F.lit("nil"))
    return done.where("refused is null").select("seq", text.alias("reply"))


@query(f"WITH {O.ROSTER}, l AS (SELECT id, id || ' ' || addr AS x FROM member WHERE state = 0) SELECT '*' || count(*) || {_NL} || string_agg({_BULK.format('x')}, '' ORDER BY id) AS reply FROM l")
def cmd_nodes(spark, sf):
    return dispatch.nodes_reply(_members(spark, sf)[0])


_LEAF_WORDS = " || ".join(f"lpad(lower(to_hex({c})), 8, '0')" for c in ["bucket", *[f"l{i}" for i in range(8)]])


@query(f"WITH {O.STORES}, l AS {O.leaves('store_a')} SELECT string_agg({_LEAF_WORDS}, '' ORDER BY bucket) AS str, NULL::VARCHAR AS error FROM l UNION ALL SELECT NULL, 'ERR failed to parse tree leaf count'")
def cmd_rtree(spark, sf):
    asked = spark.createDataFrame([(1, ["1024"]), (2, ["many"])], "seq bigint, args array<string>")
    done = dispatch.rtree(asked, merkle.leaves(T.stores(spark, sf)[0]), 1024)
    return done.select(resp.as_bulk(F.col("reply")).alias("str"), resp.as_error(F.col("reply")).alias("error"))


@query(
    f"WITH {O.STORES} SELECT CASE WHEN b IN (5, 9) THEN 1 ELSE 2 END AS seq, key, blob FROM (SELECT key, blob, CAST('0x' || substr(sha256(key), 14, 3) AS INTEGER) & 1023 AS b FROM store_b) WHERE b IN (5, 9, 700) UNION ALL SELECT * FROM (VALUES (3, 'ERR malformed bucket set', NULL), (4, 'ERR failed to parse tree leaf count', NULL))"
)
def cmd_rbucket(spark, sf):
    asked = spark.createDataFrame([(1, ["1024", "5,9,5"]), (2, ["1024", "700"]), (3, ["1024", "1,x"]), (4, ["?", "1"])], "seq bigint, args array<string>")
    refused, found = dispatch.rbucket(asked, T.stores(spark, sf)[1], 1024)
    rows = found.union(refused.select("seq", resp.as_error(F.col("reply")).alias("key"), F.lit(None).cast("string").alias("blob")))
    return rows.select(F.col("seq").cast("int").alias("seq"), "key", "blob")


@query(
    f"WITH {O.HELD}, u AS (SELECT key, seq, c0, c1, c2 FROM own_set WHERE replica = 'n0' UNION SELECT key, seq, c0, c1, c2 FROM ver WHERE coord = 'n2') SELECT key, seq FROM u v WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.key = v.key AND {O.dominates('x', 'v')})"
)
def cmd_rset(spark, sf):
    """n0's sets after all that n2 wrote was sent to it, one version a request."""
    vs = T.versions(T.writes(spark, sf))
    held = V.reconcile(T.replica_versions(vs).where("replica = 'n0'"), "key").select("key", "seq", "clock", "deleted", "value")
    return dispatch.rset(vs.where("coord = 'n2'"), held)[0].select("key", "seq")


# --- streaming


@query(f"WITH {O.COMMANDS} SELECT key, value, seq FROM last_write WHERE op = 'SET'")
def stream_last_writes(spark, sf):
    """The stream's last table equals what a batch over the whole log gives."""
    from loomkv.streaming.reconcile import fold, stream_commands
    from loomkv.streaming.folders import new_folder

    table = fold(stream_commands(spark, f"{sf}/events.parquet"), new_folder(spark, "table"), new_folder(spark, "progress"))
    return table.where("op = 'SET'").select("key", "value", "seq")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
