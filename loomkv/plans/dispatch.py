"""Commands to replies: the verb table, arity, routing, and the reply of each verb, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkv.functions import resp
from loomkv.operators import membership, merkle, quorum, ring, store
from loomkv.operators import versions as V

#: verb, least and most arguments, whether it goes to the key's owner
VERBS = [("PING", 0, 0, False), ("GET", 1, 1, True), ("SET", 2, 4, True), ("DEL", 1, 1, True), ("NODES", 0, 0, False), ("RGET", 1, 1, False), ("RSET", 2, 2, False), ("RTREE", 1, 1, False), ("RBUCKET", 2, 2, False), ("STATS", 0, 0, False)]


def verbs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VERBS, "verb string, least int, most int, clustered boolean")


def analyse(commands: DataFrame) -> DataFrame:
    """Adds verb, clustered, refused and error to commands (name, args ARRAY<STRING>): words in any case, arity before all else.

    refused: what stops a command before it is routed. error: that, or what a node's own SET finds wrong.
    """
    joined = commands.join(F.broadcast(verbs(commands.sparkSession)), F.upper("name") == F.col("verb"), "left")
    n = F.size("args")
    refused = F.when(F.col("verb").isNull(), F.concat(F.lit("ERR unknown command '"), "name", F.lit("'"))).when((n < F.col("least")) | (n > F.col("most")), F.concat(F.lit("ERR wrong number of arguments for '"), "name", F.lit("'")))
    status = store.set_status(F.col("args"))["status"]
    joined = joined.withColumn("refused", refused)
    return joined.withColumn("error", F.coalesce("refused", F.when((F.col("verb") == "SET") & (status != "OK"), status))).drop("least", "most")


def route(analysed: DataFrame, points: DataFrame, self_id: str, replicas: int = 1) -> DataFrame:
    """Adds owners (`replicas` of them) to commands that name a key; MOVED to the first of them comes before a SET's own errors.

    On an empty ring every command is served here.
    """
    keyed = F.col("refused").isNull() & F.col("clustered")
    found = ring.owners(analysed.withColumn("key", F.when(keyed, F.get("args", F.lit(0)))), points, replicas)
    where = ring.route(F.get("owners", F.lit(0)), self_id)
    return found.withColumn("error", F.when(keyed & (where != "LOCAL"), where).otherwise(F.col("error"))).drop("key")


def respond(analysed: DataFrame, live: DataFrame) -> DataFrame:
    """Adds reply, a RESP value, for PING, GET, RGET, SET and DEL against a snapshot of live entries (key, value STRING)."""
    key = F.get("args", F.lit(0))
    found = analysed.withColumn("_k", key).join(live.select(F.col("key").alias("_k"), F.col("value").alias("_v")), "_k", "left")
    reply = (
        F.when(F.col("error").isNotNull(), resp.error(F.col("error")))
        .when(F.col("verb") == "PING", resp.simple(F.lit("PONG")))
        .when(F.col("verb").isin("GET", "RGET"), resp.bulk(F.col("_v")))
        .when(F.col("verb") == "SET", resp.simple(F.lit("OK")))
        .when(F.col("verb") == "DEL", resp.integer(F.col("_v").isNotNull().cast("bigint")))
    )
    return found.withColumn("reply", reply).drop("_k", "_v")


def respond_in_order(analysed: DataFrame, live: DataFrame) -> DataFrame:
    """The same for commands (with seq) that see each other: each is answered from its key's state after all before it.

    A SET's value is its second argument; entries of `live` stand before the first command. Windows are per key and
    run in order, so a hot key streams through one task with spill.
    """
    fine = F.col("error").isNull()
    key = F.when(fine & F.col("verb").isin("GET", "RGET", "SET", "DEL"), F.get("args", F.lit(0)))
    change = F.when(fine & (F.col("verb") == "SET"), F.struct(F.get("args", F.lit(1)).alias("v"))).when(fine & (F.col("verb") == "DEL"), F.struct(F.lit(None).cast("string").alias("v")))
    keyed = analysed.withColumns({"_k": key, "_c": change})
    before = Window.partitionBy("_k", F.when(F.col("_k").isNull(), F.col("seq"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = keyed.withColumn("_s", F.last("_c", ignorenulls=True).over(before))
    found = seen.join(live.select(F.col("key").alias("_k"), F.col("value").alias("_v")), "_k", "left")
    now = F.when(F.col("_s").isNotNull(), F.col("_s.v")).otherwise(F.col("_v"))
    reply = (
        F.when(F.col("error").isNotNull(), resp.error(F.col("error")))
        .when(F.col("verb") == "PING", resp.simple(F.lit("PONG")))
        .when(F.col("verb").isin("GET", "RGET"), resp.bulk(now))
        .when(F.col("verb") == "SET", resp.simple(F.lit("OK")))
        .when(F.col("verb") == "DEL", resp.integer(now.isNotNull().cast("bigint")))
    )
    return found.withColumn("reply", reply).drop("_k", "_c", "_s", "_v")


def coordinate(routed: DataFrame, held: DataFrame, self_id: str, r: int, w: int) -> DataFrame:
    """Adds reply to routed SET, DEL and GET commands that this node owns: the quorum plan of each, against a snapshot.

    routed has up (nodes that can be reached) beside what route adds; held: replica, key, seq, coord, value, clock,
    deleted. A coordinated SET takes its second argument and looks at no other. A read takes this node's set first,
    then those of reachable peers in the order of owners, until r have answered.
    """
    mine = F.col("refused").isNull() & F.col("clustered") & ~F.coalesce(F.col("error").startswith("MOVED"), F.lit(False))
    keyed = routed.where(mine).withColumns({"key": F.get("args", F.lit(0)), "self": F.lit(self_id)})
    there = V.live(V.reconcile(held.where(F.col("replica") == self_id), "key")).select("key", F.lit(True).alias("there")).distinct()
    writes = quorum.acknowledged(keyed.where("verb = 'SET'"), w, "write", F.lit("OK")).select("seq", "reply", F.lit("+").alias("tag"))
    deletes = quorum.acknowledged(keyed.where("verb = 'DEL'").join(there, "key", "left"), w, "delete", F.coalesce(F.col("there"), F.lit(False)).cast("int").cast("string")).select("seq", "reply", F.lit(":").alias("tag"))
    gets = keyed.where("verb = 'GET'")
    needed = quorum.need(r, F.col("owners"))
    reachable = F.filter(F.array_remove("owners", self_id), lambda x: F.array_contains("up", x))
    gets = gets.withColumn("asked", F.concat(F.array(F.lit(self_id)), F.slice(reachable, F.lit(1), F.greatest(needed - 1, F.lit(0)))))
    sets_ = gets.where(F.size("asked") >= needed).select("key", "asked").distinct()  # hot keys are read once for each set of replicas
    answers = quorum.reply(quorum.read_from(held, sets_), "key", "asked").select("key", "asked", "value")
    reads = gets.join(answers, ["key", "asked"], "left").select("seq", F.when(F.size("asked") < needed, quorum.error("read", F.size("asked"), needed)).otherwise(F.col("value").cast("string")).alias("reply"), F.lit("$").alias("tag"))
    failed = F.coalesce(F.col("reply").startswith("ERR "), F.lit(False))
    done = writes.union(deletes).union(reads)
    value = F.when(failed, resp.error(F.col("reply"))).when(F.col("tag") == "+", resp.simple(F.col("reply"))).when(F.col("tag") == ":", resp.integer(F.col("reply").cast("bigint"))).otherwise(resp.bulk(F.col("reply")))
    return routed.join(done.select("seq", value.alias("_r")), "seq", "left").withColumn("reply", F.coalesce("_r", F.when(F.col("error").isNotNull(), resp.error(F.col("error"))))).drop("_r")


def nodes_reply(members: DataFrame) -> DataFrame:
    """NODES: an array of bulk strings on the wire, one for each alive member, in order of ids."""
    lines = F.array_sort(F.collect_list(F.struct("id", "line")))
    one = membership.alive(members).select("id", F.concat_ws(" ", "id", "addr").alias("line")).agg(lines.alias("x"))
    return one.select(resp.encode_array(F.transform("x", lambda e: e["line"])).alias("reply"))


def rset(requests: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RSET: the replica's sets after requests of one version each, and each request's reply; a null clock is a malformed blob."""
    fine = requests.where("clock is not null")
    after = V.reconcile(held.unionByName(fine.withColumn("seq", F.col("seq") + F.lit(1 << 60)).select(*held.columns)), "key")
    reply = F.when(F.col("clock").isNull(), resp.error(F.lit("ERR malformed version"))).otherwise(resp.simple(F.lit("OK")))
    return after.withColumn("seq", F.col("seq") % (1 << 60)), requests.select("seq", reply.alias("reply"))


def rtree(requests: DataFrame, tree: DataFrame, leaves: int) -> DataFrame:
    """RTREE: the error of a leaf count that is no number; for the count of the tree at hand, its leaves in order as hex words."""
    count = F.get("args", F.lit(0)).try_cast("int")
    word = F.concat(F.lpad(F.lower(F.hex("bucket")), 8, "0"), merkle.hex_of(*merkle.LIMBS))
    blob = tree.select(F.struct("bucket", word.alias("h")).alias("e")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["h"]), "").alias("b"))
    reply = F.when(count.isNull(), resp.error(F.lit("ERR failed to parse tree leaf count"))).when(count == leaves, resp.bulk(blob.select("b").scalar()))
    return requests.withColumn("reply", reply)


def rbucket(requests: DataFrame, entries: DataFrame, leaves: int) -> tuple[DataFrame, DataFrame]:
    """RBUCKET: the errors of malformed requests, and for the others the entries of the buckets asked for, as rows (seq, key, blob).

    requests: seq, args (leaf count, buckets with commas between them). Entries aren't packed into one reply: a bucket
    set may ask for the whole store. All requests are served in one scan.
    """
    count, asked = F.get("args", F.lit(0)).try_cast("int"), F.transform(F.split(F.get("args", F.lit(1)), ","), lambda x: x.try_cast("int"))
    error = F.when(count.isNull(), "ERR failed to parse tree leaf count").when(F.exists(asked, lambda x: x.isNull()), "ERR malformed bucket set")
    judged = requests.withColumns({"error": error, "asked": asked})
    wanted = judged.where("error is null").select("seq", F.explode(F.array_distinct("asked")).alias("bucket"))
    placed = entries.select("key", "blob", merkle.bucket_of(F.col("key"), leaves).alias("bucket"))
    return judged.where("error is not null").select("seq", resp.error(F.col("error")).alias("reply")), placed.join(wanted, "bucket").select("seq", "key", "blob")


def stats(lines: DataFrame, uptime: int) -> DataFrame:
    """STATS: one bulk string of the report's lines, uptime first; ord gives their order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "line")))
    text = F.concat(F.lit(f"uptime_seconds:{uptime}\r\n"), F.array_join(F.transform(rows, lambda e: F.concat(e["line"], F.lit("\r\n"))), ""))
    return lines.agg(text.alias("t")).select(resp.encode_bulk(F.col("t")).alias("reply"))
