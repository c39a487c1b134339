"""Operator 8: first-fit decreasing into sequences of a fixed number of tokens, in randomised groups of pieces.

A document's ids and one end id are cut every `length` tokens; pieces are dealt to groups at random and each group is
packed alone: longest first, each into the first sequence with room, found in a tournament tree of capacities.

Defined results: a null or empty text is a piece of the end id alone; every row of the input is packed, repeated rows
each, with the doc_id as it stands, null too; ties in length go by doc_id and start, nulls last; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, give_back, let_go, materialize, pick, ship
from .library_bpe import encoder, small_batches

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class CapacityTree:
    """Room left in each bin; a node has the most of its two children, so the first bin with room is a walk down."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with that much room, which it takes."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        room[k] -= size
        found = k - self.leaves
        k //= 2
        while k:
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
            k //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it of each size; the sizes come in descending order, none above the capacity."""
    tree, filled, out = CapacityTree(max(1, len(sizes)), capacity), {}, []
    for s in sizes:
        b = tree.put(s)
        at = filled.get(b, 0)
        out.append((b, at))
        filled[b] = at + s
    return out


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, with_ids: bool = False) -> DataFrame:
    """A row per piece of at most `length` ids; with_ids adds them as binary, little-endian unsigned 32-bit."""
    file = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    end, step = end_id.to_bytes(4, "little"), 4 * length

    def batch(b: pa.RecordBatch) -> dict:
        enc, k = encoder(file.value), 0
        out: dict = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        names = b.column("doc_id").to_pylist()
        for run in small_batches(x.as_py() for x in b.column("text")):
            for ids in enc.encode_many(run):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    out["doc_id"].append(names[k])
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(ids) // 4)
                    if with_ids:
                        out["ids"].append(piece)
                k += 1
        return out

    return arrow_map(pick(docs, "doc_id", "text"), batch, PIECES + ", ids binary" * with_ids, holds=True)


#: Groups that one task packs, one after the other: 128 MB of ids at the most, with groups of 4,096 pieces of 2,048.
TASK_GROUPS = 4


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = 4096, seed: int = 7) -> DataFrame:
    """Adds sequence_id (group * 2^32 + number in the group) and offset. One shuffle of the pieces, to tasks of a few groups each.

    The random key is written with the pieces, so that a task that runs again sees the same groups.
    """
    keyed = materialize(pieces.withColumn("_deal", F.rand(seed)), "pieces")
    groups = max(1, -(-keyed.count() // group_pieces))
    tasks = -(-groups // TASK_GROUPS)
    names = pieces.columns
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def packed(group: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        placed = first_fit_decreasing(rows["length"].to_pylist(), capacity)
        cols = [rows[c].combine_chunks() for c in names] + [pa.array([(group << 32) + b for b, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        now, held = None, []
        for b in it:
            group = b.column("_group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if group[lo] != now and held:
                    yield packed(now, held)
                    held = []
                now = int(group[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield packed(now, held)
        give_back()

    ship(pieces.sparkSession)
    grouped = keyed.withColumn("_group", F.floor(F.col("_deal") * groups).cast("bigint")).drop("_deal")
    return grouped.repartitionById(tasks, (F.col("_group") % tasks).cast("int")).sortWithinPartitions("_group").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, with_ids: bool = False) -> DataFrame:
    return pack_pieces(encode_pieces(docs, tokenizer_path, end_id, length, with_ids), length)
