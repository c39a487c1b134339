"""Operator 4: canonical exact digests, with byte comparison inside equal buckets.

A text's canonical form: NFKC, case folded, NFKC again, runs of white space as one space, none at the ends. Its
fingerprint is the form's 128-bit xxhash. Documents of one fingerprint are then grouped by the form's bytes, so that a
group holds equal forms only, even if two forms share a digest.

Defined results: null and empty texts are equal; n_chars is 0 then; repeated rows fall into one group; an empty table
gives no rows; group_id is the smallest doc_id of the group. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeBins, arrow_map, bounded, materialize, pick, ship, text_tie

#: Digests that may be broadcast, 16 bytes each; beyond it the join is by shuffle.
BROADCAST_DIGESTS = 500_000


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def _forms(docs: DataFrame, bits: int) -> DataFrame:
    def batch(b: pa.RecordBatch) -> dict:
        forms = [canonical(x.as_py()) for x in b.column("text")]
        return {"doc_id": b.column("doc_id"), "fingerprint": [digest(f)[: bits // 4] for f in forms], "form": forms}

    return arrow_map(pick(docs, "doc_id", "text"), batch, "doc_id bigint, fingerprint string, form binary")


def group_equal(docs: DataFrame, digests: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id, fingerprint -> group_id, group_size for every row of digests.

    Only forms whose fingerprint occurs more than once are moved. They are aggregated by their bytes, first within
    each task, so that thousands of copies leave a task as one row.
    """
    shared = materialize(digests.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "shared")
    few = shared.count() <= BROADCAST_DIGESTS
    forms = _forms(docs, bits).join(F.broadcast(shared) if few else shared, "fingerprint")
    groups = materialize(forms.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), "groups")
    collided = groups.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    if not collided.limit(1).count():
        out = digests.join(groups.drop("form"), "fingerprint", "left")
    else:  # digests shared by different forms: their documents are told apart by the bytes
        apart = _forms(docs, bits).join(collided, "fingerprint").join(groups, ["fingerprint", "form"]).select("doc_id", "fingerprint", "group_id", "group_size").distinct()
        plain = digests.join(groups.join(collided, "fingerprint", "left_anti").drop("form"), "fingerprint", "left")
        out = plain.join(collided, "fingerprint", "left_anti").unionByName(digests.join(collided, "fingerprint", "left_semi").join(apart, ["doc_id", "fingerprint"]))
    return out.withColumns({"group_id": F.coalesce("group_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))})


def fingerprint(docs: DataFrame, bits: int = 128) -> DataFrame:
    """The operator: doc_id, fingerprint, group_id, group_size of every document."""
    digests = materialize(_forms(docs, bits).select("doc_id", "fingerprint"), "digests")
    return group_equal(docs, digests, bits)


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its text edited with the next document's (descending doc_id), and their likeness.

    One shuffle of the texts into range bins of doc_id; the first document of each bin goes to the bin before it, too,
    and the very first one to the last bin. Likeness of two exact digests: 1 if the forms' bytes are equal, else 0.
    Ties in doc_id go by the text's hash.
    """
    bins = RangeBins(docs, "doc_id")
    h = F.xxhash64("text")
    base = pick(docs, "doc_id", "text").withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": h, "bin": bins.bin(text_tie(h))})
    firsts = base.groupBy("bin").agg(F.max(F.struct("key", "h")).alias("first"))
    # a row for each bin: one task can order them
    upwards = Window.orderBy("bin")
    lowest = F.first("bin").over(upwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumns({"above": F.lead("bin").over(upwards), "lowest": lowest})
    firsts = materialize(firsts.select("bin", "first.key", "first.h", "above", "lowest"), "firsts")
    # the first document of a bin is the next one of the bin above; the very first that of the lowest bin
    also = firsts.select("key", "h", F.coalesce("above", "lowest").alias("also"))
    rows = base.join(bounded(also), ["key", "h"], "left")
    here, there = F.struct("bin", F.lit(False).alias("tail")), F.struct(F.col("also").alias("bin"), F.lit(True).alias("tail"))
    rows = rows.select("doc_id", "text", "key", "h", F.explode(F.when(F.col("also").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"))
    rows = rows.select("doc_id", "text", "key", "h", "x.bin", "x.tail").repartitionById(bins.count, F.col("bin")).sortWithinPartitions("bin", "tail", F.desc("key"), F.desc("h"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            out: list[tuple] = []
            for doc_id, text, bin_, tail in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("bin").to_pylist(), b.column("tail").to_pylist()):
                text = text.as_py()
                form = canonical(text)
                now = (doc_id, text, form, digest(form), bin_, tail)
                if held and held[4] == bin_ and not held[5]:
                    out.append(_row(held, now))
                held = now
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out) if out else [()] * 7, types)], names=names)

    names = [x.split()[0] for x in EDITED.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in EDITED.split(", ")]
    ship(docs.sparkSession)
    found = materialize(rows.mapInArrow(run, EDITED), "edited")
    return group_equal(docs, found).select(*names, "group_id", "group_size")


def _row(this: tuple, nxt: tuple) -> tuple:
    half = len(this[1]) // 2
    edited = this[1][: len(this[1]) - half] + nxt[1][:half]
    form = canonical(edited)
    return this[0], len(this[1]), hashlib.sha256(edited.encode()).hexdigest(), this[3], digest(form), float(form == this[2]), float(nxt[2] == this[2])
