"""Operator 5: contiguous shards of near-equal bytes, by global prefix sums of sizes.

Documents lie in ascending doc_id. Range bins of doc_id have their totals summed first; a document's prefix is its
bin's offset plus the running sum inside the bin. Shards are cut where the middle of a document passes an equal share
of all bytes, so each shard differs from the target by less than one document.

Defined results: a null text has 0 bytes (size 16) and crc 0; ties in doc_id go by text_crc32 and size, and rows equal
in all of these are interchangeable; null doc_ids come first; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeBins, bounded, materialize, sums_before


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are read once and never shuffled.

    To the driver come the bins' cut points and one total.
    """
    bins = RangeBins(docs, "doc_id")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("bigint").alias("size"), crc.alias("text_crc32"))
    rows = materialize(rows.withColumn("bin", bins.bin(F.col("text_crc32") / F.lit(2.0**32))), "sizes")
    totals = rows.groupBy("bin").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    before = materialize(sums_before(totals, "bin", size0="s", row0="n").drop("n"), "offsets")
    size = before.agg(F.sum("s")).first()[0] or 0

    w = Window.partitionBy("bin").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"upto": F.sum("size").over(w), "nth": F.count("*").over(w)}).join(bounded(before), "bin")
    cut = F.expr(f"((2 * (size0 + upto) - size) * {shards}) div {2 * max(1, size)}")  # in whole numbers
    placed = placed.withColumns({"shard": F.least(F.lit(shards - 1), cut).cast("int"), "at": F.col("row0") + F.col("nth") - 1})
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
