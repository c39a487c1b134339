"""Operator 1: byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a pre-token's bytes, exactly one token can end the prefix's encoding. The table holds that token;
the encoding is read off backwards from the end. A token fits after another one if merging the two neighbours' bytes
again, in rank order, never joins bytes across their border. So an append only adds entries, and after an edit the old
entries are taken over again as soon as as many of them as the longest token has bytes agree.

Defined results: a null or empty text has no tokens; the decoded bytes of an encoding are the text's UTF-8 bytes;
rows with equal texts get equal results; a null doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import units
from .common import TwoGenerations, arrow_map, hold, pick

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PrefixBPE:
    """The vocabulary: tokens by rank, the two parts each was merged from, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.back: dict = {}  # reachable tokens, by their bytes from the last one on; -1 has the token
        self.reachable: set[int] = set()
        for r in sorted(self.bytes_of):  # a token's parts have lower ranks, and are known by then
            token = self.bytes_of[r]
            if len(token) == 1:
                self.parts[r] = (r, r)
                self._reach(token, r)
                continue
            last = self.table(token)
            if last is None:
                continue
            right = last[-1]
            left_end = len(token) - len(self.bytes_of[right])
            if left_end and last[left_end - 1] is not None:
                left = last[left_end - 1]
                if len(self.bytes_of[left]) == left_end:
                    self.parts[r] = (left, right)
                    self.merged[left, right] = r
                    self._reach(token, r)
        self.fit.clear()
        lens = np.zeros(max(self.bytes_of) + 1, np.int64)
        for r, t in self.bytes_of.items():
            lens[r] = len(t)
        self._lens, self._starts = lens, np.cumsum(lens) - lens
        self._flat = np.frombuffer(b"".join(self.bytes_of[r] for r in sorted(self.bytes_of)), np.uint8)

    def _reach(self, token: bytes, r: int) -> None:
        node = self.back
        for x in reversed(token):
            node = node.setdefault(x, {})
        node[-1] = r
        self.reachable.add(r)

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: undoing merges from the latest on, no merge across the border comes before them."""
        key = (a, b)
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) > 400_000:
                self.fit.clear()
            known = self.fit[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        merged, parts, limit = self.merged, self.parts, 1 << 40
        while True:
            m = merged.get((a, b))
            if m is not None and m < limit:
                return False
            left_first = a > b
            for side in (left_first, not left_first):
                if side:
                    inner = parts[a][1]
                    if inner != a:
                        limit, a = a, inner
                        break
                else:
                    inner = parts[b][0]
                    if inner != b:
                        # of equal merges the left one comes first, so one across the border wins against b's own
                        limit, b = b + 1, inner
                        break
            else:
                return True

    def extend(self, data: bytes, last: list[int | None], to: int) -> None:
        """Fill the table of prefixes up to the length given; entry i - 1 is for the prefix of i bytes."""
        fit, back, append = self.fit, self.back, last.append
        for i in range(len(last) + 1, to + 1):
            node, ends, j = back, [], i - 1
            while j >= 0:  # tokens that end here, from the shortest on
                node = node.get(data[j])
                if node is None:
                    break
                if -1 in node:
                    ends.append((j, node[-1]))
                j -= 1
            found = None
            while ends:
                j, t = ends.pop()
                if j == 0:
                    found = t
                    break
                before = last[j - 1]
                if before is None:
                    continue
                ok = fit.get((before, t))
                if ok is None:
                    ok = self.fits(before, t)
                if ok:
                    found = t
                    break
            append(found)

    def table(self, data: bytes) -> list[int | None] | None:
        last: list[int | None] = []
        self.extend(data, last, len(data))
        return last if not last or last[-1] is not None else None

    def read_off(self, last: list[int | None]) -> list[int]:
        out, i = [], len(last)
        while i:
            t = last[i - 1]
            if t is None:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(t)
            i -= len(self.bytes_of[t])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """One pre-token; one that is itself in the vocabulary is one token, as the library has it."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.read_off(self.table(data) or [None] * len(data)) if data else []

    def decode(self, ids) -> bytes:
        """All tokens' bytes, gathered at once."""
        ids = np.asarray(ids, np.int64)
        lens = self._lens[ids]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[ids] - (ends - lens), lens)
        return self._flat[at].tobytes()


class Prefixes:
    """The table of one pre-token, kept for appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries of the old prefixes don't change."""
        self.data += more
        self.bpe.extend(self.data, self.last, len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start..end; returns how many entries were computed anew."""
        old, data = self.last, self.data[:start] + new + self.data[end:]
        shift, last, same = len(new) - (end - start), old[:start], 0
        first = len(last)
        while len(last) < len(data):
            self.bpe.extend(data, last, len(last) + 1)
            i = len(last) - 1
            # an entry depends on the entries and bytes of as many places before it as the longest token has
            same = same + 1 if i >= start + len(new) and last[i] == old[i - shift] else 0
            if same >= self.bpe.longest:
                computed = len(last) - first
                last.extend(old[len(last) - shift :])
                break
        else:
            computed = len(last) - first
        self.data, self.last = data, last
        return computed

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.read_off(self.last)


class TextEncoder:
    """Whole texts to bytes of little-endian unsigned 32-bit ids; what units give is kept, within a bound."""

    def __init__(self, ranks: bytes, pattern: str, keep: int = 300_000):
        self.bpe = PrefixBPE(parse_ranks(ranks))
        self.pattern = regex.compile(pattern)
        gc.freeze()  # else each collection walks the tables
        self.kept, self.kept_pieces = TwoGenerations(keep), TwoGenerations(keep // 3)

    def pieces(self, text: str) -> bytes:
        out, kept = [], self.kept_pieces
        for p in self.pattern.findall(text):
            ids = kept.get(p)
            if ids is None:
                kept.room()
                ids = kept[p] = kept.old.get(p) or np.asarray(self.bpe.encode_piece(p.encode()), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._encode, units.long_parts(text)))

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        kept = self.kept
        if "\0" not in text:
            us = units.cut(text)
            got = list(map(kept.get, us))
            if None in got:
                kept.room()
                for i, v in enumerate(got):
                    if v is None:
                        u = us[i]
                        v = kept.get(u) or kept.old.get(u)
                        if v is None:
                            if not units.is_regular(u):
                                break
                            v = self.pieces(u)
                        kept[u] = got[i] = v
                else:
                    return b"".join(got)
            else:
                return b"".join(got)
        return self.pieces(text)


def _encoder(ranks: bytes, pattern: str) -> TextEncoder:
    return hold("prefix " + hashlib.sha256(ranks + pattern.encode()).hexdigest(), lambda: TextEncoder(ranks, pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the bytes decoded from them.

    One scan, no shuffle. The vocabulary file (under 1 MB) is read on the driver and broadcast.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def batch(b: pa.RecordBatch) -> dict:
        enc = _encoder(file.value, pattern)
        out: dict = {"doc_id": b.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in b.column("text"):
            ids = enc.encode(x.as_py())
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
        return out

    return arrow_map(pick(docs, "doc_id", "text"), batch, SCHEMA, holds=True)
