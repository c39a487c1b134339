"""Operator 6: near duplicates by SuperMinHash, banding, verification on full sets, and union-find grouping.

1. One scan gives each document's shingle set size, the set's digest, and, per distinct set, band keys and a short
   signature. Documents with equal sets form a class, represented by its smallest doc_id; copies go no further.
2. Class representatives that share a band are candidates: each with the smallest of its bucket. Candidates whose
   estimate and sizes allow it are verified on full sets, and components are formed from the links.
3. Buckets that still hold several components give the pairs across components, which are verified in the same way: a
   pair inside one component can't change it. Buckets of up to BUCKET members are expanded. Members of larger ones,
   such as pages of one template, are joined by the rarest shingles of their full sets instead, with the lengths of
   prefixes and the filter by position of set similarity joins. That is exact, whatever order the shingles are put in,
   and documents that share a template alone, at less than the threshold, don't meet: their rare shingles are their own.

With 32 bands of 4 places a pair at similarity 0.8 is missed with probability 5e-8. The estimate's bound lies six
standard deviations below the threshold.

Defined results: a null or empty text, or one of white space, has no shingles, is its own component and kept; fewer
words than k form one shingle; repeated rows are copies, and rows with one doc_id share its component; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded, materialize, pick
from .components import components
from .superminhash import band_keys, shingle_sets, short, signatures

BLOCK = 1 << 20
#: Members of a bucket that are paired with each other; larger buckets are joined by rare shingles.
BUCKET = 64
#: Numbers of shingles are counted by so many bits of them; they decide which are rare.
RARE_BITS = 18


def _blocks(b: pa.RecordBatch) -> list[tuple[int, list[bytes]]]:
    """Runs of a batch's texts as bytes, about a megabyte each."""
    out, run, n, first = [], [], 0, 0
    for i, x in enumerate(b.column("text")):
        raw = x.as_py().encode()
        if run and n + len(raw) > BLOCK:
            out.append((first, run))
            run, n, first = [], 0, i
        run.append(raw)
        n += len(raw)
    return out + [(first, run)] if run else out


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketches(docs: DataFrame, k: int, m: int, bands: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), bands, sig, and string columns carried along. Sets that the batch has met are signed once."""

    def batch(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column("doc_id"), "n_shingles": [], "digest": [], "bands": [], "sig": [], **{c: b.column(c) for c in carry}}
        for _, raw in _blocks(b):
            sets = shingle_sets(raw, k)
            digests = [_digest(s) for s in sets]
            distinct = {d: i for i, d in reversed(list(enumerate(digests))) if d is not None}
            signed = {d: n for n, d in enumerate(distinct)}
            low = signatures([sets[i] for i in distinct.values()], m)
            keys, shorts = band_keys(low, bands).tolist(), short(low)
            out["n_shingles"] += map(len, sets)
            out["digest"] += digests
            out["bands"] += [None if d is None else keys[signed[d]] for d in digests]
            out["sig"] += [None if d is None else shorts[signed[d]].tobytes() for d in digests]
        return out

    schema = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary" + "".join(f", `{c}` string" for c in carry)
    return arrow_map(pick(docs, "doc_id", "text", *carry), batch, schema)


def _estimated(pairs: DataFrame, reps: DataFrame, m: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and short signatures allow the threshold."""
    least = m * (threshold - 6 * math.sqrt(threshold * (1 - threshold) / m))

    def side(x: str) -> DataFrame:
        return reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)

    def batch(t: pa.RecordBatch) -> dict:
        if not t.num_rows:
            return {"a": [], "b": []}
        x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(t.num_rows, m) for c in ("sig_a", "sig_b"))
        keep = (x == y).sum(axis=1) >= least
        return {c: t.column(c).to_numpy()[keep] for c in "ab"}

    return arrow_map(both.select("a", "b", "sig_a", "sig_b"), batch, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full sets, which are made for the documents in pairs alone."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    full = _set_tables(ids, docs, k)
    both = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b")), "b")

    def batch(t: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(t.column("s_a"), t.column("s_b")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
        return {c: t.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"}

    return arrow_map(both.select("a", "b", "s_a", "s_b"), batch, "a bigint, b bigint")


def _set_tables(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc_id, s: the full shingle sets of some documents, written."""
    texts = pick(docs, "doc_id", "text").join(bounded(ids), "doc_id", "left_semi")

    def sets(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "s": [s.tobytes() for _, raw in _blocks(b) for s in shingle_sets(raw, k)]}

    return materialize(arrow_map(texts, sets, "doc_id bigint, s binary").dropDuplicates(["doc_id"]), "sets")


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles with the same low bits occur in all sets: 2^RARE_BITS numbers come to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RARE_BITS, np.int64)
        for b in it:
            for x in b.column("s"):
                n += np.bincount(np.frombuffer(x.as_py(), np.uint64).astype(np.int64) & ((1 << RARE_BITS) - 1), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["low", "n"])

    out = np.zeros(1 << RARE_BITS, np.int64)
    for r in sets.select("s").mapInArrow(run, "low bigint, n bigint").groupBy("low").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["low"]] = r["n"]
    return out


def prefix_pairs(hot: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents (rep) of different components (comp) that may reach the threshold, by prefixes of their sets.

    Two sets that reach it share a shingle among the rarest n - ceil(2p / (100 + p) n) + 1 of the smaller one and the
    rarest n - ceil(p / 100 n) + 1 of the larger one.
    """
    sets = _set_tables(hot.select(F.col("rep").alias("doc_id")), docs, k)
    rare = docs.sparkSession.sparkContext.broadcast(_shingle_counts(sets))
    names = ["rep", "n", "token", "at", "index"]

    def batch(t: pa.RecordBatch) -> dict:
        reps, sizes, tokens, places, index = [], [], [], [], []
        for rep, x in zip(t.column("doc_id").to_pylist(), t.column("s")):
            s = np.frombuffer(x.as_py(), np.uint64)
            n = len(s)
            probe, own = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
            order = np.argsort(rare.value[s.astype(np.int64) & ((1 << RARE_BITS) - 1)], kind="stable")[:probe]  # the sets are sorted: ties go by the shingle
            reps.append(np.full(len(order), rep))
            sizes.append(np.full(len(order), n))
            tokens.append(s[order].view(np.int64))
            places.append(np.arange(len(order)))
            index.append(np.arange(len(order)) < own)
        return {c: np.concatenate(v) if v else [] for c, v in zip(names, (reps, sizes, tokens, places, index))}

    rows = arrow_map(sets, batch, "rep bigint, n bigint, token bigint, at bigint, index boolean").join(bounded(hot), "rep")
    rows = materialize(rows, "prefixes")
    # tokens of one component alone lead nowhere; of the others each member meets the members of other components alone
    seen = rows.groupBy("token", "comp").agg(F.max("index").alias("index"))
    met = seen.groupBy("token").agg(F.count("*").alias("comps"), F.max("index").alias("index")).where("comps > 1 and index").select("token")
    seen = materialize(seen.where("index").join(met, "token").select("token", F.col("comp").alias("other")), "met")
    x = rows.join(seen, "token").where("comp <> other").select("token", "other", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = rows.where("index").select("token", F.col("comp").alias("other"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    needed = percent * (F.col("nx") + F.col("ny")) / (100.0 + percent) - 1e-6
    most = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))  # shared shingles, if this is the first
    pairs = x.join(y, ["token", "other"]).where(smaller & (100 * F.col("ny") >= percent * F.col("nx")) & (most >= needed))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 128, bands: int = 32, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; carry: a string column that stays with each row."""
    threshold = percent / 100
    extra = (carry,) if carry else ()
    rows = materialize(sketches(docs, k, m, bands, extra), "sketches")
    classes = materialize(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles")), "classes")
    own = classes.select("digest", F.col("rep"))
    reps = rows.join(own.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig")
    reps = materialize(reps, "reps")
    single = reps.dropDuplicates(["rep"])  # rows that share a doc_id but not a text are joined below

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("most")).where("centre < most").select("key", "centre")
    members = materialize(keyed.join(buckets, "key"), "members")
    stars = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(_verified(materialize(_estimated(stars, single, m, threshold), "stars"), docs, k, percent), "links")
    found = components(links)

    with_comp = members.join(found, members["rep"] == found["node"], "left").select("key", "rep", "centre", F.coalesce("component", "rep").alias("comp"))
    mixed = with_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = materialize(with_comp.join(mixed, "key"), "open")
    large = materialize(open_.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "large")
    small = open_.join(large, "key", "left_anti")
    x, y = small.alias("x"), small.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.rep") != F.col("x.centre")))
    across = across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    if large.limit(1).count():
        hot = materialize(open_.join(large, "key", "left_semi").select("rep", "comp").distinct(), "hot")
        across = across.union(materialize(prefix_pairs(hot, docs, k, percent), "prefix-pairs"))
    across = across.distinct()
    more = materialize(_verified(materialize(_estimated(across, single, m, threshold), "across"), docs, k, percent), "more")

    same_id = rows.join(own, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count():  # doc_ids that several rows have hold their classes together
        links = links.union(same_id.join(repeated, same_id["b"] == repeated["doc_id"]).select("a", "b"))
    found = components(links.union(more))
    named = classes.join(found, classes["rep"] == found["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest", *extra).join(named, "digest", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id").eqNullSafe(comp)).alias("kept"), *extra)
