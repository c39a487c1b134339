"""Small literal tables with the rows that the semantics call for."""

import random

import pytest
from pyspark.sql import functions as F

from loomkv.functions import clocks, hashing, resp
from loomkv.operators import eviction, membership, merkle, quorum, ring, sketch, store, telemetry
from loomkv.operators import versions as V
from loomkv.plans import dispatch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CLOCKS = [({"n1": 2, "n2": 1}, {"n1": 2, "n2": 1}, "Equal"), ({"n1": 2}, {"n1": 2, "n2": 0}, "Equal"), ({"n1": 3, "n2": 1}, {"n1": 2, "n2": 1}, "After"), ({"n1": 1}, {"n1": 2}, "Before"), ({"n1": 2, "n2": 1}, {"n1": 1, "n2": 2}, "Concurrent"), ({"n1": 1}, {"n2": 1}, "Concurrent"), (None, {}, "Equal"), (None, {"a": 1}, "Before")]


def test_clock_order(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CLOCKS)], "i int, a map<string,bigint>, b map<string,bigint>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", clocks.compare(F.col("a"), F.col("b"))).collect())


def test_clock_merge_and_increment(spark):
    df = spark.createDataFrame([({"n1": 3, "n2": 1}, {"n1": 1, "n2": 2, "n3": 5})], "a map<string,bigint>, b map<string,bigint>")
    r = df.select(clocks.merge(F.col("a"), F.col("b")).alias("m"), clocks.increment(F.col("a"), F.lit("n2")).alias("i"), clocks.increment(F.col("a"), F.lit("z")).alias("z")).first()
    assert r.m == {"n1": 3, "n2": 2, "n3": 5} and r.i == {"n1": 3, "n2": 2} and r.z == {"n1": 3, "n2": 1, "z": 1}


def siblings(spark, *vs):
    data = [("k", i, v, c, d) for i, (v, c, d) in enumerate(vs)]
    return spark.createDataFrame(data, "key string, seq bigint, value string, clock map<string,bigint>, deleted boolean")


@pytest.mark.parametrize(
    "vs,want",
    [
        ([("a", {"n1": 1}, False)], [0]),
        ([("old", {"n1": 1}, False), ("new", {"n1": 2}, False)], [1]),
        ([("new", {"n1": 2}, False), ("old", {"n1": 1}, False)], [0]),
        ([("x", {"n1": 1}, False), ("x", {"n1": 1}, False)], [0]),
        ([("x", {"n1": 1}, False), ("y", {"n2": 1}, False)], [0, 1]),
        ([("v", {"a": 1}, False), (None, {"a": 2}, True)], [1]),
        ([(None, {"a": 2}, True), ("stale", {"a": 1}, False)], [0]),
        ([("v", {"a": 1}, False), (None, {"b": 1}, True)], [0, 1]),
        ([("x", {"n1": 1}, False), ("other", {"n1": 1}, False)], [0]),
    ],
)
def test_reconcile(spark, vs, want):
    assert sorted(r.seq for r in V.reconcile(siblings(spark, *vs), "key").collect()) == want


def test_equal_sets(spark):
    a = siblings(spark, ("x", {"n1": 1}, False), ("y", {"n2": 1}, False))
    b = siblings(spark, ("y", {"n2": 1}, False), ("x", {"n1": 1, "n9": 0}, False))
    c = siblings(spark, ("y", {"n2": 2}, False), ("x", {"n1": 1}, False))
    assert rows(V.equal(a, b, "key")) == [("k", True)] and rows(V.equal(a, c, "key")) == [("k", False)]


def test_reapable(spark):
    now, h = 1_700_000_000, 3600
    cases = {"live": [(False, 0)], "live_aged": [(False, 0), (True, now - 2 * h)], "fresh": [(True, now - 60)], "exact": [(True, now - h)], "aged": [(True, now - 2 * h)], "aged_fresh": [(True, now - 2 * h), (True, now - 60)], "aged_older": [(True, now - 2 * h), (True, now - 3 * h)]}
    df = spark.createDataFrame([(k, d, t) for k, v in cases.items() for d, t in v], "key string, deleted boolean, deleted_at bigint")
    got = dict(rows(df.groupBy("key").agg(V.reapable(F.lit(now), h).alias("r"))))
    assert {k for k, v in got.items() if v} == {"aged", "aged_older"}


def test_expiry_bound(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' as now, null as e union all select timestamp'2024-01-01', timestamp'2024-01-01' union all select timestamp'2024-01-01 00:00:00.000001', timestamp'2024-01-01'")
    assert sorted(r[0] for r in df.select(store.expired(F.col("e").cast("timestamp"), F.col("now"))).collect()) == [False, False, True]


def test_limits_are_bytes(spark):
    df = spark.createDataFrame([("", "v"), ("toolong", "v"), ("abcd", "v"), ("éé", "v"), ("ééx", "v"), ("k", "toolong")], "k string, v string")
    got = [r[0] for r in df.select(store.validate(F.col("k"), F.col("v"), 4, 2)).collect()]
    assert got == ["ErrEmptyKey", "ErrKeyTooLarge", "ok", "ok", "ErrKeyTooLarge", "ErrValueTooLarge"]


def test_fnv(spark):
    def model(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >= 1 << 63 else h

    words = ["", "a", "key-1", "clé", "键", "🙂", "x" * 300]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    assert [r[0] for r in df.select(hashing.fnv1a64(F.col("k"))).collect()] == list(map(model, words))


def test_ring(spark):
    keys = spark.range(10000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    four = ring.points(spark, ["a", "b", "c", "d"])
    before, after = dict(rows(ring.owner(keys, four))), dict(rows(ring.owner(keys, ring.remove(four, "c"))))
    assert set(before.values()) == set("abcd")
    assert all(after[k] == v for k, v in before.items() if v != "c") and "c" not in after.values()
    three = {r.key: r.owners for r in ring.owners(keys.limit(500), ring.points(spark, list("abcde")), 3).collect()}
    assert all(len(set(o)) == 3 for o in three.values())
    two = ring.owners(keys.limit(5), ring.points(spark, ["a", "b"]), 5).collect()
    assert all(len(r.owners) == 2 for r in two)
    none = ring.owner(keys.limit(3), ring.points(spark, [])).collect()
    assert all(r.owner is None for r in none)


def entries(spark, **kv):
    return spark.createDataFrame(list(kv.items()), "key string, blob string")


def test_merkle(spark):
    a = entries(spark, a="1", b="2", c="3", d="4")
    changed, missing = entries(spark, a="1", b="2", c="x", d="4"), entries(spark, a="1", b="2", d="4")
    bucket = a.where("key = 'c'").select(hashing.merkle_bucket(F.col("key"), 64)).first()[0]
    la = merkle.leaves(a, 64)
    for other in (changed, missing):
        assert rows(merkle.diff(la, merkle.leaves(other, 64), 64, 64)) == [(bucket,)]
    assert rows(merkle.diff(la, merkle.leaves(a.orderBy(F.desc("key")), 64), 64, 64)) == []
    assert rows(merkle.root(la, 64)) != rows(merkle.root(merkle.leaves(changed, 64), 64))
    assert hashing.next_power_of_two(1000) == 1024
    with pytest.raises(ValueError):
        merkle.diff(la, la, 64, 128)
    one = entries(spark, ab="c"), spark.createDataFrame([("abc", "")], "key string, blob string")
    assert rows(merkle.diff(merkle.leaves(one[0], 1), merkle.leaves(one[1], 1), 1, 1)) == [(0,)]


def test_membership(spark):
    claims = [("b", "x", 0, 1), ("b", "y", 2, 3), ("c", "x", 0, 5), ("c", "y", 2, 2), ("d", "x", 0, 4), ("d", "y", 2, 4), ("a", "me", 0, 0), ("a", "me", 2, 5)]
    df = spark.createDataFrame([(i, a, s, n, k) for k, (i, a, s, n) in enumerate(claims)], "id string, addr string, state int, incarnation bigint, arrival bigint")
    assert rows(membership.merge(df, "a")) == [("a", "me", 0, 6), ("b", "y", 2, 3), ("c", "x", 0, 5), ("d", "x", 2, 4)]
    seen = spark.createDataFrame([("a", 0, 0), ("b", 0, 90), ("c", 0, 99), ("d", 0, 95)], "id string, state int, last_seen bigint")
    assert [r.state for r in membership.detect_failures(seen, "a", F.lit(100), 5).orderBy("id").collect()] == [0, 2, 0, 0]


def test_quantiles(spark):
    data = [50] * 60 + [200] * 25 + [400] * 10 + [900] * 4 + [5_000_000]
    df = spark.createDataFrame([("GET", x) for x in data], "command string, ns bigint")
    bounds = [100, 250, 500, 1000]
    got = {r.q: r.ns for r in telemetry.quantiles(telemetry.histogram(df, bounds), [0.5, 0.95, 0.99, 0.999], bounds).collect()}
    assert got == {0.5: 100, 0.95: 500, 0.99: 1000, 0.999: 1000}


def test_eviction_golden():
    lru = eviction.Replay("lru", 4)
    for k in ("k0", "k1", "k2", "k3"):
        lru.step("SET", k)
    lru.step("GET", "k0")
    assert lru.step("SET", "new") == ("set", "k1")
    lfu = eviction.Replay("lfu", 4)
    for k in ("k0", "k1", "k2", "k3"):
        lfu.step("SET", k)
    for k in ("k0", "k0", "k0", "k2", "k2", "k3"):
        lfu.step("GET", k)
    assert lfu.step("SET", "new") == ("set", "k1")
    tiny = eviction.Replay("tinylfu", 4)
    for k in ("k0", "k1", "k2", "k3"):
        tiny.step("SET", k)
    for k in ("k1", "k2", "k3"):
        for _ in range(3):
            tiny.step("GET", k)
    assert tiny.step("SET", "new") == ("refused", "new")  # until its count beats the victim's
    tries = [tiny.step("SET", "new") for _ in range(16)]
    at = next(i for i, t in enumerate(tries) if t[0] == "set")
    assert all(t == ("refused", "new") for t in tries[:at]) and tries[at][1] in {"k0", "k1", "k2", "k3"} and "new" in tiny.entries


@pytest.mark.parametrize("policy", ["lru", "lfu"])
def test_victims_are_the_least_of_all(policy):
    """Against a scan of all incumbents, ties by the oldest insertion."""
    r = random.Random(3)
    state, entries, tick = eviction.Replay(policy, 6), {}, 0
    for _ in range(3000):
        op, key = r.choice(["GET", "GET", "SET", "SET", "DEL"]), f"k{r.randint(0, 14)}"
        got = state.step(op, key)
        tick += 1
        if op == "GET" and key in entries:
            entries[key] = tick if policy == "lru" else entries[key] + 1
        elif op == "DEL":
            entries.pop(key, None)
        elif op == "SET":
            entries[key] = tick if policy == "lru" else 5
            if len(entries) > 6:
                loser = min((k for k in entries if k != key), key=entries.get)
                assert got == ("set", loser)
                del entries[loser]
            else:
                assert got == ("set", None)
        assert state.entries == set(entries)


@pytest.mark.parametrize("policy", ["lru", "lfu", "tinylfu"])
def test_replay_takes_little_time(policy):
    import time

    def took(capacity):
        r, state = random.Random(1), eviction.Replay(policy, capacity)
        keys = [f"k{r.randint(0, 4 * capacity)}" for _ in range(20_000)]
        began = time.process_time()
        for k in keys:
            state.step("SET", k)
        return time.process_time() - began

    assert took(4000) < 5 * took(100) + 0.2  # not in proportion to what is held


def test_replay_is_in_order(spark):
    log = spark.createDataFrame([(i, f"k{i % 7}", "SET" if i % 3 else "GET") for i in range(500)], "seq bigint, key string, op string")
    got = eviction.replay(log, "lru", 3, 1).orderBy("seq").collect()
    model = eviction.Replay("lru", 3)
    assert [(r.outcome, r.evicted) for r in got] == [model.step(r.op, r.key) for r in got]


def test_sketch():
    s = sketch.Sketch(64)
    assert s.estimate("x") == 0
    for _ in range(100):
        s.add("x")
    assert s.estimate("x") == 15
    s.reset()
    assert s.estimate("x") == 7
    small = sketch.Sketch(10)
    for _ in range(100):
        small.add("x")
    assert small.estimate("x") == 7


def test_quorum_text(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "a", ["a", "c"]), (["a", "b", "c"], "a", ["a"])], "owners array<string>, self string, up array<string>")
    assert [r.reply for r in quorum.acknowledged(df, 2, "write", F.lit("OK")).collect()] == ["OK", "ERR write quorum not met: 1 of 2 replicas"]


def test_dispatch(spark):
    cmds = spark.createDataFrame([("ping", []), ("get", ["a"]), ("GET", ["b"]), ("Set", ["a", "1", "px", "0"]), ("set", ["a", "1"]), ("del", ["a"]), ("del", ["zz"]), ("nope", []), ("get", [])], "name string, args array<string>")
    live = spark.createDataFrame([("a", "é")], "key string, value string")
    wire = {(r.name, tuple(r.args)): r.w for r in dispatch.respond(dispatch.analyse(cmds), live).withColumn("w", resp.encode(F.col("reply"))).collect()}
    assert wire["ping", ()] == "+PONG\r\n" and wire["get", ("a",)] == "$2\r\né\r\n" and wire["GET", ("b",)] == "$-1\r\n"
    assert wire["Set", ("a", "1", "px", "0")].startswith("-ERR") and wire["set", ("a", "1")] == "+OK\r\n"
    assert wire["del", ("a",)] == ":1\r\n" and wire["del", ("zz",)] == ":0\r\n"
    assert wire["nope", ()] == "-ERR unknown command 'nope'\r\n" and wire["get", ()] == "-ERR wrong number of arguments for 'get'\r\n"


def test_parse_refuses(spark):
    bad = ["", "!x\r\n", "*1\r\n$3\r\nGE\r\n", "*2\r\n$3\r\nGET\r\n", "*1\r\n:1\r\n", "*-1\r\n", "+OK\r\n"]
    df = spark.createDataFrame([(w,) for w in bad], "w string")
    assert not any(r[0] for r in df.select(resp.parse_command(F.col("w"))["ok"]).collect())


def test_routes_before_a_nodes_own_errors(spark):
    """Arity first, then MOVED, then what SET finds wrong; keyless commands and empty rings are served here."""
    cmds = spark.createDataFrame([(1, "set", ["a", "1", "px", "0"]), (2, "ping", []), (3, "get", []), (4, "nope", ["a"]), (5, "rget", ["a"])], "seq bigint, name string, args array<string>")
    analysed = dispatch.analyse(cmds)
    owner = ring.owner(spark.createDataFrame([("a",)], "key string"), ring.points(spark, ["x", "y"])).first().owner
    other = {"x": "y", "y": "x"}[owner]
    there = {r.seq: r.error for r in dispatch.route(analysed, ring.points(spark, ["x", "y"]), other).collect()}
    assert there[1] == f"MOVED {owner}" and there[2] is None and there[3].startswith("ERR wrong") and there[4].startswith("ERR unknown") and there[5] is None
    for points, me in ((ring.points(spark, ["x", "y"]), owner), (ring.points(spark, []), "x")):
        assert {r.seq: r.error for r in dispatch.route(analysed, points, me).collect()}[1] == "ERR invalid ttl"


def test_commands_see_each_other(spark):
    cmds = [(1, "get", ["a"]), (2, "set", ["a", "1"]), (3, "GET", ["a"]), (4, "set", ["a", "2", "px", "0"]), (5, "get", ["a"]), (6, "del", ["a"]), (7, "del", ["a"]), (8, "get", ["a"]), (9, "ping", []), (10, "get", ["b"])]
    df = dispatch.analyse(spark.createDataFrame(cmds, "seq bigint, name string, args array<string>"))
    live = spark.createDataFrame([("a", "0"), ("b", "9")], "key string, value string")
    got = {r.seq: r.w for r in dispatch.respond_in_order(df, live).withColumn("w", resp.encode(F.col("reply"))).collect()}
    assert got[1] == "$1\r\n0\r\n" and got[3] == got[5] == "$1\r\n1\r\n" and got[4].startswith("-ERR") and got[6] == ":1\r\n" and got[7] == ":0\r\n"
    assert got[8] == "$-1\r\n" and got[9] == "+PONG\r\n" and got[10] == "$1\r\n9\r\n"


def test_reconcile_of_many(spark):
    """A long history, and many concurrent versions, more than a piece holds."""
    rows = [("chain", i, {"n0": i + 1}) for i in range(300)] + [("apart", i, {f"w{i}": 1}) for i in range(70)] + [("equal", i, {"n0": 1}) for i in range(40)] + [("none", 0, None), ("none", 1, {})]
    got = rows_of(V.reconcile(spark.createDataFrame(rows, "key string, seq bigint, clock map<string,bigint>"), "key"))
    assert got["chain"] == [299] and got["apart"] == list(range(70)) and got["equal"] == [0] and got["none"] == [0]


def test_histories_end_before_pieces(spark, monkeypatch):
    """Of a history of one version after the other a single one is dealt into pieces; concurrent ones all are."""
    dealt = []
    few = V.reconcile_few
    monkeypatch.setattr(V, "reconcile_few", lambda versions, *key: dealt.append(rows_of(versions)) or few(versions, *key))
    data = [("chain", i, {"n0": i + 1, "n1": i // 2}) for i in range(300)] + [("apart", i, {f"w{i}": 1}) for i in range(20)] + [("two", i, {f"w{i % 2}": i // 2 + 1}) for i in range(100)]
    got = rows_of(V.reconcile(spark.createDataFrame(data, "key string, seq bigint, clock map<string,bigint>"), "key"))
    assert dealt[0]["chain"] == [299] and len(dealt[0]["apart"]) == 20 and len(dealt[0]["two"]) == 51
    assert got == {"chain": [299], "apart": list(range(20)), "two": [98, 99]}


def test_reconcile_equals_all_pairs(spark):
    """Clocks drawn at random, some null, empty, equal or with zeros, against a comparison of every version with every other."""
    r = random.Random(5)
    draw = lambda: r.choice([None, {}]) if r.random() < 0.05 else {n: r.randrange(5) for n in r.sample(["a", "b", "c", "d"], r.randrange(5))}
    data = [(f"k{k}", i, draw()) for k in range(30) for i in range(r.choice([1, 2, 15, 40, 120]))]
    at = lambda c: tuple((c or {}).get(n, 0) for n in "abcd")

    def gone(key, seq, clock):
        return any(k == key and all(x >= y for x, y in zip(at(c), at(clock))) and (at(c) != at(clock) or s < seq) for k, s, c in data)

    want = {}
    for key, seq, clock in data:
        if not gone(key, seq, clock):
            want.setdefault(key, []).append(seq)
    assert rows_of(V.reconcile(spark.createDataFrame(data, "key string, seq bigint, clock map<string,bigint>"), "key")) == want


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.key, []).append(r.seq)
    return {k: sorted(v) for k, v in out.items()}


def test_larger_trees(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("b").alias("blob"))
    small = {r.key: r.b for r in df.select("key", hashing.merkle_bucket(F.col("key"), 4096).alias("b")).collect()}
    large = {r.key: r.b for r in df.select("key", hashing.merkle_bucket(F.col("key"), 1 << 20).alias("b")).collect()}
    assert all(large[k] % 4096 == small[k] for k in small) and max(large.values()) > 4096
    a, b = merkle.leaves(df, 1 << 16), merkle.leaves(df.where("key <> 'k7'"), 1 << 16)
    assert merkle.diff(a, b, 1 << 16, 1 << 16).count() == 1
