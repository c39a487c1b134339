"""Byte-level BPE of many pre-tokens at once: in each round every pre-token's pair of lowest rank is merged, in all of them.

The pre-tokens of a batch lie end to end in one array of symbols, with the rank of each neighbouring pair beside it;
a merge changes two ranks only. A pre-token without a pair that merges leaves the array.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int32(2**31 - 1)
_BITS = 20
#: Printable bytes stand for themselves in byte-level vocabularies; the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _BITS)


class RankMerger:
    """Ranks are found in a table by a hash of the pair; pairs that share a place there, by binary search."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        made: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            made.setdefault(vocab[a + b], r)
        if any(max(made.get(vocab[a], -1), made.get(vocab[b], -1)) >= r for r, (a, b) in enumerate(pairs)):
            raise ValueError("a merge comes before its parts: all places of a pair can't be merged at once")
        left = np.array([vocab[a] for a, _ in pairs], np.uint32)
        right = np.array([vocab[b] for _, b in pairs], np.uint32)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        slot = _slot(left, right)
        self.table = np.full(1 << _BITS, -1, np.int32)
        self.table[slot] = np.arange(len(pairs))
        self.table[np.bincount(slot, minlength=1 << _BITS) > 1] = -2
        self.left, self.right = left, right
        lacking = [c for c in BYTE_CHAR.values() if c not in vocab or c + suffix not in vocab]
        if lacking:
            raise ValueError("the vocabulary lacks bytes")
        self.inner = np.array([vocab[BYTE_CHAR[b]] for b in range(256)], np.uint32)
        self.final = np.array([vocab[BYTE_CHAR[b] + suffix] for b in range(256)], np.uint32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.left):
            return np.full(len(left), NEVER)
        rank = self.table[_slot(left, right)]
        out = np.where((rank >= 0) & (self.left[rank] == left) & (self.right[rank] == right), rank, NEVER)
        shared = np.flatnonzero(rank == -2)
        if len(shared):
            key = (left[shared].astype(np.uint64) << np.uint64(32)) | right[shared]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[shared] = np.where(self.keys[at] == key, self.ranks[at], NEVER)
        return out

    def survivors(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words (bytes end to end, and their numbers, none of them 0), and how many each word has."""
        ids = self.inner[raw]
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        ids[last] = self.final[raw[last]]
        rank = np.full(len(ids), NEVER)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[last] = NEVER
        word = np.arange(len(sizes))
        counts, done_ids, done_words = np.zeros(len(sizes), np.int64), [], []
        while len(ids):
            ends = np.flatnonzero(last)
            starts = np.append(0, ends[:-1] + 1)
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(ids)))
            done = lowest == NEVER
            if done.any():
                counts[word[done]] = size[done]
                whole = np.repeat(done, size)
                done_ids.append(ids[whole])
                done_words.append(word[done])
                ids, last, rank = ids[~whole], last[~whole], rank[~whole]
                lowest, size, word = lowest[~done], size[~done], word[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            # a pair of two equal symbols may overlap itself: of neighbours in a run, every second one goes
            touch = np.diff(hit) == 1
            if touch.any():
                run = np.append(True, ~touch)
                first = hit[run][np.cumsum(run) - 1]
                hit = hit[(hit - first) % 2 == 0]
            ids[hit] = self.results[rank[hit]]
            last[hit] = last[hit + 1]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, last, rank = ids[stay], last[stay], rank[stay]
            at = hit - np.arange(len(hit))  # each merge before it has taken one place
            rank[at] = NEVER
            before = at[at > 0] - 1
            at = np.concatenate([at, before])
            at = at[~last[at]]
            rank[at] = self._rank(ids[at], ids[at + 1])
        if not done_ids:
            return np.zeros(0, np.uint32), counts
        # words left in an order of their own: put them back
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        n = counts[word]
        begin = (np.cumsum(counts) - counts)[word]
        out = np.empty(len(ids), np.uint32)
        out[np.arange(len(ids)) + np.repeat(begin - (np.cumsum(n) - n), n)] = ids
        return out, counts

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each."""
        return self.survivors(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))[1]


def plain_bpe(spec: dict) -> bool:
    """Whether the file's model is byte-level BPE by ranks alone."""
    m = spec["model"]
    off = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    return m.get("type") == "BPE" and not any(m.get(k) for k in off)


#: The matches of byte-level pre-tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def kind_of(spec: dict) -> tuple[str, str] | None:
    """("bytes" or "words", pattern of its matches) of a tokenizer file whose steps are those that units rely on; else None.

    "bytes": no normaliser, the byte-level pre-tokenizer with its own pattern. "words": NFC, white space folded, lower
    case; matches of a pattern that never crosses white space, then bytes. Added tokens are special ones whose strings
    hold no white space and `<|`, matched as they stand.
    """
    if not plain_bpe(spec):
        return None
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or "<|" not in t["content"] or any(c.isspace() for c in t["content"]):
            return None
    norm, pre = spec["normalizer"], spec["pre_tokenizer"]
    if norm is None and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return ("bytes", BYTE_LEVEL) if not spec["model"].get("end_of_word_suffix") else None
    if norm is None or norm["type"] != "Sequence" or [n["type"] for n in norm["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
        return None
    fold = norm["normalizers"][1]
    if fold["pattern"] != {"Regex": r"\s+"} or fold["content"] != " " or pre["type"] != "Sequence" or len(pre["pretokenizers"]) != 2:
        return None
    split, byte = pre["pretokenizers"]
    pattern = split.get("pattern", {}).get("Regex")
    # the pattern's parts match letters, digits and what is neither, never white space
    whole = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if whole and byte["type"] == "ByteLevel" and not byte.get("add_prefix_space") and byte.get("use_regex") is False:
        return "words", pattern
    return None
