"""DuckDB SQL of the queries, written from the semantics and not from the plans."""

from __future__ import annotations

COMMANDS = """
command_log AS (
  SELECT event_id AS seq, ts, 'user:' || user_id AS key,
         CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'purchase' THEN 'SET' WHEN 'signup' THEN 'SET' ELSE 'DEL' END AS op,
         value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) * 60 AS ttl_s, 'n' || (event_id % 3) AS coord
  FROM events),
last_write AS (SELECT * FROM command_log WHERE op <> 'GET' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1),
stored AS (SELECT *, CASE WHEN seq % 2 = 0 THEN ts + to_seconds(ttl_s) END AS expires_at FROM last_write WHERE op = 'SET'),
clock_now AS (SELECT max(ts) AS now FROM command_log)
"""


def _vis(seq: str, o: int) -> str:
    return f"(({seq} // 3) + {o}) % 3 <> 0"


def _versions() -> str:
    entry = []
    for m in range(3):
        seen = " ".join(f"WHEN 'n{o}' THEN (SELECT max(e.own) FROM w e WHERE e.key = w.key AND e.coord = 'n{m}' AND (e.ts, e.seq) < (w.ts, w.seq) AND {_vis('e.seq', o)})" for o in range(3) if o != m)
        entry.append(f"coalesce(CASE coord WHEN 'n{m}' THEN own {seen} END, 0) AS c{m}")
    return (
        "w AS (SELECT seq, ts, key, coord, value, op = 'DEL' AS deleted, count(*) OVER (PARTITION BY key, coord ORDER BY ts, seq) AS own FROM command_log WHERE op <> 'GET'), "
        f"ver AS (SELECT seq, ts, key, coord, value, deleted, {', '.join(entry)} FROM w)"
    )


def dominates(a: str, b: str) -> str:
    return f"({a}.c0 >= {b}.c0 AND {a}.c1 >= {b}.c1 AND {a}.c2 >= {b}.c2 AND ({a}.c0 > {b}.c0 OR {a}.c1 > {b}.c1 OR {a}.c2 > {b}.c2))"


VERSIONS = f"{COMMANDS}, {_versions()}"
SURVIVORS = f"{VERSIONS}, sib AS (SELECT * FROM ver v WHERE NOT EXISTS (SELECT 1 FROM ver x WHERE x.key = v.key AND ({dominates('x', 'v')} OR (x.c0 = v.c0 AND x.c1 = v.c1 AND x.c2 = v.c2 AND x.seq < v.seq))))"

HELD = f"""{VERSIONS}, held AS (
  SELECT 'n0' AS replica, 0 AS place, * FROM ver WHERE coord = 'n0' OR {_vis('seq', 0)}
  UNION ALL SELECT 'n1', 1, * FROM ver WHERE coord = 'n1' OR {_vis('seq', 1)}
  UNION ALL SELECT 'n2', 2, * FROM ver WHERE coord = 'n2' OR {_vis('seq', 2)}),
own_set AS (SELECT * FROM held v WHERE place < 2 AND NOT EXISTS (SELECT 1 FROM held x WHERE x.replica = v.replica AND x.key = v.key AND {dominates('x', 'v')})),
answered AS (SELECT key, seq, any_value(coord) AS coord, any_value(value) AS value, any_value(deleted) AS deleted, any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, min(place) AS place FROM own_set GROUP BY key, seq),
merged AS (SELECT * FROM answered v WHERE NOT EXISTS (SELECT 1 FROM answered x WHERE x.key = v.key AND {dominates('x', 'v')}))"""


def fnv(key: str) -> str:
    """The unsigned hash, of the key's UTF-8 bytes."""
    codes = f"list_transform(range(octet_length(encode({key}))), lambda i: CAST('0x' || substr(hex(encode({key})), 2 * i + 1, 2) AS UHUGEINT))"
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, {codes}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


RING = f"""
ring AS (SELECT 'n' || n AS node, CAST(CAST({fnv("'n' || n || '#' || j")} AS HUGEINT) - 9223372036854775808 AS BIGINT) AS u FROM range(5) a(n), range(100) b(j)),
ring_key AS (SELECT c_name AS key FROM customer UNION ALL SELECT unnest(['', 'clé-é', '键'])),
hashed AS (SELECT key, CAST(CAST({fnv('key')} AS HUGEINT) - 9223372036854775808 AS BIGINT) AS u FROM ring_key)
"""


def owned(where: str = "TRUE") -> str:
    """key, owner on the ring of the nodes that the condition lets pass."""
    return f"(SELECT h.key, coalesce(r.node, (SELECT arg_min(node, u) FROM ring WHERE {where})) AS owner FROM hashed h ASOF LEFT JOIN (SELECT * FROM ring WHERE {where}) r ON h.u <= r.u)"


WALK = "walk AS (SELECT key, node, min(struct_pack(late := CASE WHEN r.u < h.u THEN 1 ELSE 0 END, u := r.u)) AS d FROM hashed h, ring r GROUP BY key, node), nth AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY d) AS n FROM walk)"

LIMBS = ", ".join(f"bit_xor(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS l{i}" for i in range(8))


def leaves(store: str) -> str:
    return f"(SELECT bucket, {LIMBS} FROM (SELECT CAST('0x' || substr(sha256(key), 14, 3) AS INTEGER) & 1023 AS bucket, sha256(unhex(sha256(key)) || encode(blob)) AS d FROM {store}) GROUP BY bucket)"


STORES = """
store_a AS (SELECT 'order:' || o_orderkey AS key, o_orderstatus || '|' || o_orderpriority AS blob FROM orders),
store_b AS (SELECT 'order:' || o_orderkey AS key, o_orderstatus || '|' || o_orderpriority || CASE WHEN o_orderkey % 97 = 0 THEN '|x' ELSE '' END AS blob FROM orders WHERE o_orderkey % 193 <> 0)
"""
DIFF = f"{STORES}, la AS {leaves('store_a')}, lb AS {leaves('store_b')}, differing AS (SELECT coalesce(la.bucket, lb.bucket) AS bucket FROM la FULL JOIN lb ON la.bucket = lb.bucket WHERE (la.l0, la.l1, la.l2, la.l3, la.l4, la.l5, la.l6, la.l7) IS DISTINCT FROM (lb.l0, lb.l1, lb.l2, lb.l3, lb.l4, lb.l5, lb.l6, lb.l7))"


def merkle_root() -> str:
    hexes = " || ".join(f"lpad(lower(to_hex(l{i})), 8, '0')" for i in range(8))
    sql = f"WITH {STORES}, t10 AS (SELECT b AS bucket, coalesce({hexes}, '') AS h FROM range(1024) r(b) LEFT JOIN {leaves('store_a')} x ON x.bucket = r.b)"
    for k in range(9, -1, -1):
        sql += f", t{k} AS (SELECT x.bucket // 2 AS bucket, sha256(unhex(x.h || y.h)) AS h FROM t{k + 1} x JOIN t{k + 1} y ON y.bucket = x.bucket + 1 WHERE x.bucket % 2 = 0)"
    return sql + " SELECT h AS root FROM t0"


ROSTER = """
roster AS (SELECT r AS reporter, s_name AS id, '10.0.0.' || (s_suppkey % 250) || ':' || (r + 7000) AS addr, CAST((s_suppkey + r * 2) % 3 AS INTEGER) AS state, (s_suppkey * 7 + r * 3) % 5 AS incarnation, s_suppkey * 10 + r AS arrival FROM supplier, range(3) t(r)),
self AS (SELECT min(s_name) AS id FROM supplier),
member AS (
  SELECT id, arg_min(addr, struct_pack(i := -incarnation, a := arrival)) AS addr, max(struct_pack(i := incarnation, s := state)).s AS state, max(incarnation) AS incarnation FROM roster WHERE id NOT IN (SELECT id FROM self) GROUP BY id
  UNION ALL
  SELECT id, arg_min(addr, arrival), 0, greatest(coalesce(max(incarnation + 1) FILTER (state <> 0), 0), 0) FROM roster WHERE id IN (SELECT id FROM self) GROUP BY id)
"""

BOUNDS = [250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000, 5000000, 25000000, 100000000, 500000000]
SERVED = f"""{COMMANDS},
state_then AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM command_log),
served AS (SELECT seq, op AS command, (seq * 7919) % 700000 * 1000 AS ns,
  CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 17 = 0 THEN 'error' WHEN op = 'GET' AND prev = 'SET' THEN 'hit' WHEN op = 'GET' THEN 'miss' ELSE 'ok' END AS outcome FROM state_then),
timed AS (SELECT command, ns, coalesce(list_position(list_transform({BOUNDS}, lambda b: ns <= b), true) - 1, 16) AS bucket FROM served WHERE outcome IS NOT NULL),
hist AS (SELECT command, CAST(bucket AS INTEGER) AS bucket, count(*) AS n, CAST(sum(ns) AS BIGINT) AS sum_ns FROM timed GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY command ORDER BY bucket) AS r, sum(n) OVER (PARTITION BY command) AS whole FROM hist),
quant AS (SELECT command, q, min([{', '.join(map(str, BOUNDS + BOUNDS[-1:]))}][bucket + 1])::BIGINT AS ns FROM upto, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q) WHERE r >= q * whole GROUP BY command, q)
"""

QUORUM = """{c}, sent AS (
  SELECT seq, key, op, value, coord AS self, list_filter(['n0', 'n1', 'n2'], lambda x: x <> coord) AS peers,
         list_filter(['n0', 'n1', 'n2'], lambda x: ((seq // 7) + CAST(substr(x, 2) AS BIGINT)) % 4 <> 0) AS up FROM command_log WHERE op <> 'GET'),
acked AS (SELECT *, CAST(1 + len(list_intersect(peers, up)) AS INTEGER) AS acks FROM sent),
missed AS (SELECT unnest(list_filter(peers, lambda x: NOT list_contains(up, x))) AS target, key, seq FROM sent),
waiting AS (SELECT target, key, max(seq) AS seq FROM missed GROUP BY target, key)
""".format(c=COMMANDS)


def cell(key: str, width: int) -> str:
    """The sketch's column in row r."""
    return f"CAST((CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) + r * CAST('0x' || substr(md5({key}), 9, 8) AS BIGINT)) % {width} AS BIGINT)"


def replay(policy: str, capacity: int, shards: int) -> str:
    """Each shard's commands one after the other, with its entries as a list of (key, score, born): LRU scores by the last access, LFU by counting."""
    set_score, get_score = ("n", "n") if policy == "lru" else ("5", "e.s + 1")
    return f"""
WITH RECURSIVE {COMMANDS},
c AS MATERIALIZED (SELECT CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {shards} AS INTEGER) AS shard, seq, key, op, row_number() OVER (PARTITION BY CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {shards} ORDER BY seq) AS n FROM command_log),
run AS (
  SELECT shard, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS key, '' AS op, '' AS outcome, NULL::VARCHAR AS evicted, []::STRUCT(k VARCHAR, s BIGINT, b BIGINT)[] AS es FROM (SELECT DISTINCT shard FROM c)
  UNION ALL
  SELECT shard, n, seq, key, op,
    CASE op WHEN 'GET' THEN CASE WHEN there THEN 'hit' ELSE 'miss' END WHEN 'DEL' THEN CASE WHEN there THEN 'deleted' ELSE 'absent' END ELSE 'set' END,
    gone.k, CASE WHEN gone IS NULL THEN es ELSE list_filter(es, lambda e: e.k <> gone.k) END
  FROM (
    SELECT *, CASE WHEN op = 'SET' AND len(es) > {capacity} THEN list_reduce(list_filter(es, lambda e: e.k <> key), lambda a, x: CASE WHEN (x.s, x.b) < (a.s, a.b) THEN x ELSE a END) END AS gone
    FROM (
      SELECT r.shard, c.n, c.seq, c.key, c.op, list_contains(list_transform(r.es, lambda e: e.k), c.key) AS there,
        CASE WHEN c.op = 'DEL' THEN list_filter(r.es, lambda e: e.k <> c.key)
             WHEN c.op = 'GET' THEN list_transform(r.es, lambda e: CASE WHEN e.k = c.key THEN struct_pack(k := e.k, s := CAST({get_score.replace('n', 'c.n')} AS BIGINT), b := e.b) ELSE e END)
             WHEN list_contains(list_transform(r.es, lambda e: e.k), c.key) THEN list_transform(r.es, lambda e: CASE WHEN e.k = c.key THEN struct_pack(k := e.k, s := CAST({set_score.replace('n', 'c.n')} AS BIGINT), b := e.b) ELSE e END)
             ELSE list_append(r.es, struct_pack(k := c.key, s := CAST({set_score.replace('n', 'c.n')} AS BIGINT), b := c.n)) END AS es
      FROM run r JOIN c ON c.shard = r.shard AND c.n = r.n + 1)))
SELECT seq, key, op, outcome, evicted FROM run WHERE n > 0"""
