"""Operator 7: quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams and a few signs of junk (repeated words, capitals, marks); a document's counts are
damped, weighted by rarity and projected on the leading singular vectors of a labelled sample. The sample's vectors
are broadcast; every document's cosines with all of them are computed exactly, in blocks, and the labels of the
nearest ones vote by a power of their similarity.

The sample is bounded: at most `sample` labelled documents of each class, those with the smallest hash of doc_id. All
statistics of the model come from the sample; labels, lang, source and doc_id are never inputs of a score.

Defined results: a null or empty text has no terms and scores 0.5, whatever the sample; rows with equal texts score the
same, with any doc_id or none; without labelled rows every score is 0.5; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick

DIMS = 2048
SIGNS = 8
PART = 1 << 20

_CLASS = np.zeros(256, np.uint8)  # 1 space, 2 capital, 3 digit, 4 mark, 5 other letter
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4
_CLASS[97:123] = 5
_CLASS[128:] = 5


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Runs of (owner, bytes, overlap) of about a megabyte; a long text lies in several parts, cut before white space, and each holds `overlap` bytes of the next."""
    owners, run, over, n = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t) if len(t) - at <= PART else at + PART
            if end < len(t):  # a word longer than a part is cut all the same
                blank = max(t.rfind(s, at + 1, end + 1) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
                end = blank if blank > 0 else end
            piece = t[at : end + 2]
            if run and n + len(piece) > PART:
                yield owners, run, over
                owners, run, over, n = [], [], [], 0
            owners.append(i)
            run.append(piece)
            over.append(len(piece) - (end - at))
            n += len(piece)
            at = end
            if at >= len(t):
                break
    if run:
        yield owners, run, over


def terms(texts: list[bytes]) -> np.ndarray:
    """Counts, a row per text: hashed trigrams, then the signs (repeated words, words, capitals, letters, digits, marks, white space, distinct words)."""
    out = np.zeros((len(texts), DIMS + SIGNS), np.float32)
    seen: dict[int, np.ndarray] = {}  # of texts in several parts: the words so far, and the last one
    last: dict[int, np.uint64] = {}
    for owners, run, over in _parts(texts):
        n = len(run)
        a = np.frombuffer(b" \n".join(run) + b" \n", np.uint8)
        sizes = np.array([len(t) + 2 for t in run])
        row = np.repeat(np.arange(n), sizes)
        after = np.zeros(len(a), bool)  # bytes that the next part counts
        for end, k in zip(np.cumsum(sizes) - 2, over):
            after[end - k : end] = True
        x = a.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        inside = (row[:-2] == row[2:]) & ~after[:-2]
        counts = np.bincount(row[:-2][inside] * DIMS + (h[inside] >> np.uint32(21)), minlength=n * DIMS).reshape(n, DIMS)
        kind = _CLASS[a]
        kind[after] = 0
        signs = np.bincount(row * 6 + kind, minlength=n * 6).reshape(n, 6)
        blank = (kind == 1) | after
        start = ~blank
        start[1:] &= blank[:-1]
        starts = np.flatnonzero(start)
        more = np.zeros((n, SIGNS), np.int64)
        more[:, 2], more[:, 3], more[:, 4], more[:, 5] = signs[:, 2], signs[:, 5], signs[:, 3], signs[:, 4]
        more[:, 6] = np.maximum(0, signs[:, 1] - 2)
        if len(starts):
            total = np.add.reduceat(_places(a, blank, starts), starts)
            owner = row[starts]
            more[:, 1] = np.bincount(owner, minlength=n)
            same = (total[1:] == total[:-1]) & (owner[1:] == owner[:-1])
            more[:, 0] = np.bincount(owner[1:][same], minlength=n)
            order = np.lexsort((total, owner))
            fresh = np.append(True, (total[order][1:] != total[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
            more[:, 7] = np.bincount(owner[order][fresh], minlength=n)
            for j, i in enumerate(owners):
                if len(texts[i]) > PART:
                    lo, hi = np.searchsorted(owner, [j, j + 1])
                    if lo < hi:
                        known = seen.get(i, total[:0])
                        seen[i] = np.union1d(known, total[lo:hi])
                        more[j, 7] = len(seen[i]) - len(known)
                        more[j, 0] += last.get(i) == total[lo]
                        last[i] = total[hi - 1]
        np.add.at(out, np.array(owners), np.concatenate([counts, more], axis=1).astype(np.float32))
    return out


def _places(a: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes of words, weighted by their place in the word."""
    at = np.arange(len(a), dtype=np.uint64)
    first = np.zeros(len(a), np.uint64)
    first[starts[0] :] = np.repeat(at[starts], np.diff(np.append(starts, len(a))))
    return (a.astype(np.uint64) * ~blank) * (at - first + np.uint64(7)) ** np.uint64(5)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1: damped trigram shares times idf, and the signs as shares of their text; empty texts stay 0."""
    tri, sign = counts[:, :DIMS], counts[:, DIMS:]
    x = np.log1p(tri) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    words, chars = np.maximum(sign[:, 1:2], 1), np.maximum(sign[:, 2:6].sum(axis=1, keepdims=True), 1)
    s = np.concatenate([sign[:, 0:1] / words, np.sqrt(sign[:, 2:3] / chars), np.sqrt(sign[:, 4:5] / chars), np.sqrt(sign[:, 5:6] / chars), 1 - sign[:, 7:8] / words], axis=1)
    s *= (sign[:, 1:2] > 0) * SIGN_WEIGHT
    return np.concatenate([x, s], axis=1).astype(np.float32)


SIGN_WEIGHT = np.array([1.5, 1.5, 1.0, 1.5, 0.5], np.float32)


class Model:
    """Rarity weights, projection, the sample's vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, seed: int = 1):
        self.neighbours, self.labels = neighbours, labels.astype(np.float32)
        n = len(counts)
        self.idf = (np.log((1 + n) / (1 + (counts[:, :DIMS] > 0).sum(axis=0))) + 0.1).astype(np.float32)
        x = weighted(counts, self.idf)
        self.mean = x.mean(axis=0) if n else np.zeros(DIMS + len(SIGN_WEIGHT), np.float32)
        x = x - self.mean
        if n:  # randomised range finder with two power steps, then an exact small decomposition
            rank = min(rank, *x.shape)
            q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32))[0]
            for _ in range(2):
                q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
            self.basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.copy()
        else:
            self.basis = np.zeros((len(self.mean), 1), np.float32)
        self.vectors = self._unit(x @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes], block: int = 512) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        for lo in range(0, len(texts), block):
            counts = terms(texts[lo : lo + block])
            x = self._unit((weighted(counts, self.idf) - self.mean) @ self.basis)
            near = x @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            at = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, at, axis=1), 0) ** 4 + 1e-9
            vote = (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1)
            out[lo : lo + block] = np.where(counts[:, DIMS + 1] > 0, vote, 0.5)
        return np.round(out, 6)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, rank: int = 48, neighbours: int = 15) -> Model:
    """Fit on at most `sample` labelled rows of each class outside the held-out quarter: 8 KB each come to the driver. Labels without a document leave the sample smaller."""
    usable = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = []
    for label in (0, 1):
        top = usable.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen += [(r["doc_id"], label) for r in top.collect()]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, quality int")
    texts = pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")

    def batch(b: pa.RecordBatch) -> dict:
        counts = terms([x.as_py().encode() for x in b.column("text")])
        return {"doc_id": b.column("doc_id"), "quality": b.column("quality"), "counts": [c.tobytes() for c in counts]}

    rows = arrow_map(texts.select("doc_id", "quality", "text"), batch, "doc_id bigint, quality int, counts binary").collect()
    rows = list({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["counts"]))}.values())
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.float32).reshape(len(rows), DIMS + SIGNS)
    return Model(counts, np.array([r["quality"] for r in rows]), rank, neighbours)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. The model (under 5 MB, bounded by the sample) is broadcast; one scan, no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> dict:
        scores = known.value.scores([x.as_py().encode() for x in b.column("text")])
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out())
    return arrow_map(rows, batch, "doc_id bigint, held_out boolean, score double, predicted int")


def kept_by_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents, in all their columns, that the model doesn't reject."""
    known, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def batch(b: pa.RecordBatch) -> dict:
        keep = pa.array(known.value.scores([(x.as_py() or "").encode() for x in b.column("text")]) >= threshold)
        return {c: b.column(c).filter(keep) for c in names}

    return arrow_map(docs, batch, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
