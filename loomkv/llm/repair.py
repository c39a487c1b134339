"""Operator 3: token ids in Re-Pair compressed shard files, with random access.

A shard holds documents in ascending doc_id. Pairs of neighbouring ids are replaced by nonterminals until no pair
occurs twice (see grammar). The file has the rules, each nonterminal's expansion length, running sums of lengths at
every 1024th symbol, and the shortened sequence; a range of ids is decoded from the symbols that cover it, whose bytes
alone are read of the sequence.

File: magic, bytes in a symbol, base (first nonterminal), numbers of documents, rules, symbols and ids; doc_ids (int64)
with a null flag each (uint8), ids per document (int64), rules (two symbols each), expansion lengths (uint32), running
sums (int64), a crc32 of all before it; then the sequence and its crc32. All little-endian.

Defined results: a null or empty text is the end id alone; ties in doc_id go by the text's hash; null doc_ids come
first; repeated rows are stored each; an empty table writes no file and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeBins, bounded, keep_heap, materialize, pick, shared_path, ship, sums_before, text_tie
from .grammar import compress
from .library_bpe import encoder, small_batches

MAGIC, HEAD = b"LRP2", struct.Struct("<4sIIQQQQ")
#: Symbols between two running sums.
SAMPLE = 1024


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Rules come in runs that don't refer to themselves: a run at a time."""
    out, at = np.zeros(len(rules), np.uint32), 0
    inner = np.where(rules >= base, rules.astype(np.int64) - base, -1)
    newest = inner.max(axis=1) if len(rules) else np.zeros(0, np.int64)
    while at < len(rules):
        within = newest[at:] >= at
        end = at + int(within.argmax()) if within.any() else len(rules)
        part = inner[at:end]
        out[at:end] = np.where(part >= 0, out[part], 1).sum(axis=1)
        at = end
    return out


def _sizes(seq: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(seq), np.int64)
    inner = seq >= base
    out[inner] = lengths[seq[inner] - np.uint32(base)]
    return out


def _table(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Expansions of nonterminals, end to end: each symbol gives way to its two symbols, put where they begin, until terminals are left."""
    sizes = _sizes(symbols, lengths, base)
    out = np.empty(int(sizes.sum()), np.uint32)
    seq, at = symbols, np.cumsum(sizes) - sizes
    while len(seq):
        pairs = rules[seq - np.uint32(base)]
        left, right = pairs[:, 0], pairs[:, 1]
        seq, at = np.concatenate([left, right]), np.concatenate([at, at + _sizes(left, lengths, base)])
        last = seq < base
        out[at[last]] = seq[last]
        seq, at = seq[~last], at[~last]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """All ids of a sequence, from a table of the expansions of its distinct nonterminals, which has no more ids than the sequence gives."""
    inner = np.flatnonzero(seq >= base)
    which = seq[inner] - np.uint32(base)
    used = np.flatnonzero(np.bincount(which, minlength=len(rules)))
    table = _table((used + base).astype(np.uint32), rules, lengths, base)
    start = np.zeros(len(rules), np.int64)
    start[used] = np.cumsum(lengths[used], dtype=np.int64) - lengths[used]
    sizes, at = np.ones(len(seq), np.int64), np.arange(len(table), len(table) + len(seq))  # a terminal stands for itself
    sizes[inner], at[inner] = lengths[which], start[which]
    ends = np.cumsum(sizes)
    place = np.repeat(at - (ends - sizes), sizes)
    place += np.arange(len(place))
    return np.concatenate([table, seq])[place]


def _narrow(symbols: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(symbols.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u4").reshape(-1)


def pack_shard(doc_ids: list[int | None], ids: list[bytes], base: int) -> bytes:
    """A shard file's bytes, of documents whose ids come as little-endian unsigned 32-bit integers."""
    seq = np.frombuffer(b"".join(ids), "<u4")
    rules, short = compress(seq, base)
    lengths = expansion_lengths(rules, base)
    width = max(1, -(-(base + len(rules)).bit_length() // 8))
    out = io.BytesIO()
    out.write(HEAD.pack(MAGIC, width, base, len(doc_ids), len(rules), len(short), len(seq)))
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.write(np.array([x is None for x in doc_ids], "u1").tobytes())
    out.write(np.array([len(x) // 4 for x in ids], "<i8").tobytes())
    out.write(_narrow(rules, width))
    out.write(lengths.astype("<u4").tobytes())
    sizes = _sizes(short, lengths, base)
    out.write((np.cumsum(sizes) - sizes)[::SAMPLE].astype("<i8").tobytes())
    tables, body = out.getvalue(), _narrow(short, width)
    return b"".join([tables, struct.pack("<I", zlib.crc32(tables)), body, struct.pack("<I", zlib.crc32(body))])


def head_of(data: bytes) -> tuple:
    return HEAD.unpack_from(data)


class Shard:
    """A shard file; read_at(place, n) gives bytes of it. The tables are read at once, the sequence as it is needed."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        head = read_at(0, HEAD.size)
        if len(head) < HEAD.size or head[:4] != MAGIC:
            raise ValueError("not a shard file")
        _, self.width, self.base, docs, rules, self.symbols, self.n_ids = HEAD.unpack(head)
        sums = -(-self.symbols // SAMPLE)
        sizes = [8 * docs, docs, 8 * docs, 2 * rules * self.width, 4 * rules, 8 * sums, 4]
        data = read_at(HEAD.size, sum(sizes))
        cut = [data[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))]
        if struct.pack("<I", zlib.crc32(data[:-4], zlib.crc32(head))) != cut[6]:
            raise ValueError("not a whole shard file")
        null = np.frombuffer(cut[1], "u1").tolist()
        self.doc_ids = [None if x else v for v, x in zip(np.frombuffer(cut[0], "<i8").tolist(), null)]
        self.doc_tokens = np.frombuffer(cut[2], "<i8")
        self.rules = _wide(cut[3], self.width).reshape(-1, 2)
        self.lengths, self.sums = np.frombuffer(cut[4], "<u4"), np.frombuffer(cut[5], "<i8")
        self.read_at, self.body = read_at, HEAD.size + sum(sizes)

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n])

    def ids(self) -> np.ndarray:
        """All ids; the sequence's checksum is compared."""
        n = self.symbols * self.width
        data = self.read_at(self.body, n + 4)
        if struct.pack("<I", zlib.crc32(data[:n])) != data[n:]:
            raise ValueError("not a whole shard file")
        return expand(_wide(data[:n], self.width), self.rules, self.lengths, self.base)

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start + length, from the symbols between the running sums that enclose them."""
        end = min(start + length, self.n_ids)
        if end <= start:
            return np.zeros(0, np.uint32)
        lo = int(np.searchsorted(self.sums, start, "right")) - 1
        hi = int(np.searchsorted(self.sums, end, "left"))
        first, last = lo * SAMPLE, min(hi * SAMPLE, self.symbols)
        seq = _wide(self.read_at(self.body + first * self.width, (last - first) * self.width), self.width)
        before = int(self.sums[lo]) + np.append(0, np.cumsum(_sizes(seq, self.lengths, self.base)))
        a, b = int(np.searchsorted(before, start, "right")) - 1, int(np.searchsorted(before, end, "left"))
        got = expand(seq[a:b], self.rules, self.lengths, self.base)
        return got[start - before[a] :][: end - start]

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document."""
        return self.read(int(self.doc_tokens[:k].sum()), int(self.doc_tokens[k]))


MANIFEST = "bin int, nth int, path string, n_docs bigint, n_tokens bigint, n_symbols bigint, n_rules bigint"


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Write shard files to a folder that all executors share; returns the manifest, one row per shard.

    One shuffle of the texts, into range bins of doc_id. A file's name is new in each attempt of a task, and only
    files of attempts that ended well are in the manifest.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    bins = RangeBins(docs, "doc_id")
    rows = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("bin", bins.bin(text_tie(F.col("h")))).repartitionById(bins.count, F.col("bin"))
    rows = rows.sortWithinPartitions("bin", F.asc_nulls_first("doc_id"), "h").drop("h")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(file.value, 1 << 24, 1 << 19, 21), end_id.to_bytes(4, "little")
        keep_heap(256 << 20)  # a shard's arrays are larger than a block's
        base = max(enc.tokenizer.get_vocab().values()) + 1
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: tuple[list, list] = ([], [])
        bin_, nth, n = None, 0, 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held, nth, n
            if held[0]:
                data = pack_shard(*held, base)
                name = f"{bin_:07d}-{nth:05d}-{uuid.uuid4().hex}.lrp"
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(data)
                head = head_of(data)
                out.append((bin_, nth, f"{folder}/{name}", head[3], head[6], head[5], head[4]))
                held, nth, n = ([], []), nth + 1, 0

        for b in it:
            names, bins, k = b.column("doc_id").to_pylist(), b.column("bin").to_pylist(), 0
            for texts in small_batches(x.as_py() for x in b.column("text")):
                for ids in enc.encode_many(texts):
                    if bins[k] != bin_ or n >= shard_tokens:
                        flush()
                        if bins[k] != bin_:
                            bin_, nth = bins[k], 0
                    held[0].append(names[k])
                    held[1].append(ids + end)
                    n += len(ids) // 4 + 1
                    k += 1
        flush()
        cols = [list(x) for x in zip(*out)] or [[] for _ in range(7)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4])], names=[x.split()[0] for x in MANIFEST.split(", ")])

    ship(spark)
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, crc32 of its ids, perhaps the ids.

    Offsets: totals of the bins are summed in one task, a row each; those of a bin's shards by a window.
    """
    totals = materialize(sums_before(manifest.groupBy("bin").agg(F.sum("n_tokens").alias("n")), "bin", bin0="n").drop("n"), "offsets")
    at = F.expr("bin0 + sum(n_tokens) over (partition by bin order by nth rows unbounded preceding) - n_tokens").alias("start0")
    files = manifest.join(bounded(totals), "bin").select("path", at)
    n = max(1, min(manifest.count(), 20_000))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, start in zip(b.column("path").to_pylist(), b.column("start0").to_pylist()):
                store, p = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(p) as f:
                    shard = Shard.of(f.read())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.doc_tokens)
                each = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), shard.doc_tokens.tolist())]
                cols = [shard.doc_ids, (start + ends - shard.doc_tokens), shard.doc_tokens, [zlib.crc32(x) for x in each]]
                arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(each, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in READ.split(", ")] + ["ids"] * with_ids)

    return files.repartition(n).mapInArrow(run, READ + ", ids binary" * with_ids)


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """The round trip: shard files in the shared folder, and what is read back from them."""
    folder = shared_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder if "://" in folder else f"file://{folder.removeprefix('file:')}", tokenizer_path, end_id))
