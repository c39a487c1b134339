"""Whole texts to ids as the tokenizers library gives them, by units of text that are encoded once each.

A block of texts is one array of bytes, cut into units, which are looked up by a hash in a bounded table and compared
byte by byte with what is found. Units that aren't known are merged together (see merges); what isn't plain in them,
and files of another make than kind_of knows, go through the library itself.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from . import units
from .common import hold
from .merges import RankMerger, kind_of

_U = np.uint64
#: Bytes of text that are encoded at once, but for longer texts without a place to cut. Larger blocks take less time, and memory.
BLOCK = 1 << 18
#: Longer pre-tokens are left to the library: rounds are as many as a pre-token's merges.
LONG = 64
#: Characters below it are of the first Unicode blocks: their classes and cases never change, and NFC leaves them alone.
FIRST = "İ"
#: The table's size, and how many bytes of units are kept before it starts anew.
TABLE, KEPT = 20, 1 << 23
_POWER, _GOLD = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, bool)  # bytes of which letters consist, in valid UTF-8, if no other byte above 127 is there
_LETTER[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
_SIGN = np.zeros(256, bool)  # a match of its own behind letters, where nothing follows
_SIGN[list(b",.;:!?")] = True


def parts(text: str, size: int = 1 << 22) -> Iterator[str]:
    """A long text in parts that begin at a space."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + sizes[i], one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> int:
        at = self.n
        if at + len(more) > len(self.data):
            self.data = np.concatenate([self.data[:at], np.empty(at + 2 * len(more), self.data.dtype)])
        self.data[at : at + len(more)] = more
        self.n += len(more)
        return at


class LibraryEncoder:
    """Units of text are encoded alone where the tokenizer's rules make that the same; otherwise whole texts are.

    Tokenizers that drop white space: any space or line feed is a place to cut, since no added token, normalisation
    step or match of theirs holds one. Byte-level ones: a single space or line feed between other characters is (see
    units). Texts with the string of an added token or a NUL, or with a unit that is irregular, go to the library.
    """

    def __init__(self, file: bytes, kept: int = KEPT, block: int = BLOCK, bits: int = TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(file)
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.added = [t["content"] for t in spec["added_tokens"]]
        kind = kind_of(spec)
        self.merger = None
        if kind:
            self.drops_space, self.words = kind[0] == "words", regex.compile(kind[1])
            try:
                self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"], spec["model"].get("end_of_word_suffix") or "")
            except ValueError:  # merges that can't be made in step: the library does it all
                pass
        self.most, self.block, self.slots = kept, block, 1 << bits
        self.table = np.full(self.slots, -1, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.table[:] = -1
        self.bytes, self.ids = _Pool(np.uint8), _Pool(np.uint32)
        self.hash, self.at, self.size, self.id_at, self.id_n = _Pool(_U), *[_Pool(np.int32) for _ in range(4)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.merger:
            return self._whole(texts)
        found: list[list[bytes] | None] = [[] for _ in texts]
        owner, block, n = [], [], 0

        def flush() -> None:
            for i, ids in zip(owner, self._block(block)):
                if ids is None:
                    found[i] = None
                elif found[i] is not None:
                    found[i].append(ids)
            owner.clear()
            block.clear()

        for i, text in enumerate(texts):
            if "\0" in text or (not self.drops_space and any(s in text for s in self.added)):
                found[i] = None
                continue
            for part in parts(text, self.block) if self.drops_space else units.long_parts(text, self.block):
                raw = part.encode()
                if block and n + len(raw) > self.block:
                    flush()
                    n = 0
                owner.append(i)
                block.append(raw)
                n += len(raw) + 1
        if block:
            flush()
        out = [None if x is None else x[0] if len(x) == 1 else b"".join(x) for x in found]
        slow = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(slow, self._whole([texts[i] for i in slow])):
            out[i] = v
        return out

    def _block(self, raws: list[bytes]) -> list[bytes | None]:
        """Ids of texts without NUL; None where a unit is irregular."""
        a = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        line = (a == 10) | (a == 0)
        blank = line | (a == 32)
        if self.drops_space:
            start = ~blank
            start[1:] &= blank[:-1]
            starts = np.flatnonzero(start)
            b = a[~blank]
            end = blank.copy()
            end[0], end[1:] = False, blank[1:] & ~blank[:-1]
            sizes = np.flatnonzero(end) - starts
        else:  # a space begins a unit, a line feed is one; so is the NUL behind a text
            blank[1:] |= line[:-1]
            blank[0] = True
            starts, b = np.flatnonzero(blank), a
            sizes = np.diff(np.append(starts, len(a)))
        bounds = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))
        if not len(starts):
            return [b""] * len(raws)
        if self.bytes.n > self.most or self.hash.n > self.slots:
            self._clear()
        first = np.cumsum(sizes) - sizes
        entry = self._entries(b, first, sizes)
        # exact comparison; units whose hashes agree by chance are irregular
        same = self.size.data[entry] == sizes
        if not same.all():
            entry = np.where(same, entry, 0)
        place = np.repeat(np.where(same, self.at.data[entry] - first, 0), sizes)
        place += np.arange(len(b))
        np.minimum(place, self.bytes.n - 1, out=place)
        differ = np.flatnonzero(self.bytes.data[place] != b)
        n = self.id_n.data[entry]
        odd = (n < 0) | ~same
        if len(differ):
            odd[np.searchsorted(first, differ, "right") - 1] = True
        if not self.drops_space:  # white space behind a line feed joins it
            joins = np.flatnonzero((a[:-1] == 10) & ((a[1:] == 10) | (a[1:] == 32)))
            odd[np.searchsorted(first, joins, "right") - 1] = True
        n = np.where(odd, 0, n)
        flat = self.ids.data[_ragged(self.id_at.data[entry], n)].astype("<u4").tobytes()
        ends = np.append(0, np.cumsum(n))[bounds].tolist()
        bad = np.append(0, np.cumsum(odd))[bounds].tolist()
        out: list[bytes | None] = []
        at = lost = 0
        for e, k in zip(ends, bad):
            out.append(flat[4 * at : 4 * e] if k == lost else None)
            at, lost = e, k
        return out

    def _entries(self, b: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each unit's hash; new ones are made."""
        power = np.full(int(sizes.max()), _POWER)
        power[0] = _U(1)
        power = np.multiply.accumulate(power)
        inside = np.arange(len(b)) - np.repeat(first, sizes)
        term = power[inside]
        term *= b + _U(1)
        h = np.add.reduceat(term, first) + sizes.astype(_U) * _GOLD
        h = (h ^ (h >> _U(32))) * _GOLD
        h ^= h >> _U(29)
        slot = h & _U(self.slots - 1)
        entry = self.table[slot].astype(np.int64)
        fresh = np.flatnonzero((entry < 0) | (self.hash.data[entry] != h))
        if len(fresh):
            values, which, back = np.unique(h[fresh], return_index=True, return_inverse=True)
            which = fresh[which]
            n = self.hash.add(values)
            entry[fresh] = n + back
            raw = b[_ragged(first[which], sizes[which])]
            at = self.bytes.add(raw)
            new = sizes[which]
            self.at.add(at + np.cumsum(new) - new)
            self.size.add(new)
            ids, counts = self._fresh(raw, new)
            start = self.ids.add(ids)
            many = np.maximum(counts, 0)
            self.id_at.add(start + np.cumsum(many) - many)
            self.id_n.add(counts)
            self.table[values & _U(self.slots - 1)] = np.arange(n, n + len(values))
        return entry

    def _fresh(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new units, end to end, and how many each has, -1 where it is irregular."""
        first = np.cumsum(sizes) - sizes
        last = first + sizes - 1
        letter = _LETTER[raw]
        letter[1:] &= ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))  # signs of multiplication and division
        if not self.drops_space:
            letter[first[(raw[first] == 32) & (sizes > 1)]] = True
        tail = _SIGN[raw[last]] & (sizes > 1 + (raw[first] == 32))
        plain = np.add.reduceat(letter, first, dtype=np.int64) == sizes - tail
        plain &= sizes <= LONG
        if not self.drops_space:
            plain &= (raw[first] != 32) | (sizes > 1 + tail)
        chosen, cut = np.flatnonzero(plain), tail[plain]
        places = _ragged(first[chosen], sizes[chosen])
        text = raw[places]
        if self.drops_space:
            text[(text >= 65) & (text <= 90)] += 32
            high = np.flatnonzero((text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)) + 1
            text[high] += 32
        words = np.repeat(sizes[chosen] - cut, 1 + cut)
        words[(np.cumsum(1 + cut) - 1)[cut]] = 1
        got, per_word = self.merger.survivors(text, words)
        counts = np.zeros(len(sizes), np.int64)
        counts[chosen] = np.add.reduceat(per_word, np.cumsum(1 + cut) - (1 + cut)) if len(chosen) else 0
        others = np.flatnonzero(~plain)
        if not len(others):
            return got, counts
        data = raw.tobytes()
        found = self._odd([data[s : s + n].decode() for s, n in zip(first[others].tolist(), sizes[others].tolist())])
        counts[others] = [-1 if x is None else len(x) // 4 for x in found]
        many = np.maximum(counts, 0)
        start = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.uint32)
        out[_ragged(start[chosen], counts[chosen])] = got
        out[_ragged(start[others], many[others])] = np.frombuffer(b"".join(x or b"" for x in found), "<u4")
        return out, counts

    def _odd(self, strings: list[str]) -> list[bytes | None]:
        """Ids of units that aren't letters alone."""
        out: list[bytes | None] = [None] * len(strings)
        several, whole, words = {}, [], {}
        for i, u in enumerate(strings):
            if u == "\0":  # it stands behind each text
                out[i] = b""
            elif not self.drops_space and not units.is_regular(u):
                continue
            elif max(u) < FIRST and "<|" not in u:
                several[i] = found = self.words.findall(u.lower() if self.drops_space else u)
                words.update(dict.fromkeys(found))
            else:
                whole.append(i)
        raw = {w: r for w in words if len(r := w.encode()) <= LONG}
        if raw:
            ids, counts = self.merger.survivors(np.frombuffer(b"".join(raw.values()), np.uint8), np.fromiter(map(len, raw.values()), np.int64, len(raw)))
            flat, start = ids.astype("<u4").tobytes(), 0
            for w, end in zip(raw, (4 * np.cumsum(counts)).tolist()):
                words[w] = flat[start:end]
                start = end
        long = [w for w, v in words.items() if v is None]
        words.update(zip(long, self._whole(long)))
        for i, found in several.items():
            out[i] = b"".join([words[w] for w in found])
        for i, v in zip(whole, self._whole([strings[i] for i in whole])):
            out[i] = v
        return out


def encoder(file: bytes, *sizes: int) -> LibraryEncoder:
    """One for each file, as long as the worker's tasks use it. sizes: kept, block and bits, where they aren't the usual ones."""
    return hold(f"library {hashlib.sha256(file).hexdigest()} {sizes}", lambda: LibraryEncoder(file, *sizes))


def small_batches(texts: Iterable[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about so many characters together, one text at least."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > chars:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run
