"""Shingle sets and SuperMinHash signatures of batches of texts, in numpy.

Words are runs of bytes other than ASCII white space, with A-Z in lower case; since no byte of a longer UTF-8 character
is white space, bytes give the same words as code points. A shingle is the 64-bit hash of k successive words.

SuperMinHash: each element draws, layer by layer, a number in [j, j + 1) for a place that no earlier layer of its own
has used; a place keeps the least number. A document is done as soon as its greatest number is below the next layer.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_POWER = _U(0xD6E8FEB86659FD93)
_STEP = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes], long: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of words of each text. A long text alone is taken in parts."""
    if len(texts) == 1 and len(texts[0]) > long:
        text, at, found = texts[0], 0, []
        while at < len(text):
            end = text.find(b" ", at + long)
            end = len(text) if end < 0 else end
            found.append(_word_hashes([text[at:end]])[0])
            at = end
        words = np.concatenate(found)
        return words, np.array([len(words)])
    return _word_hashes(texts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    a = _LOWER[raw]
    blank = _BLANK[a]
    start = ~blank
    start[1:] &= blank[:-1]
    starts = np.flatnonzero(start)
    sizes = np.array([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(sizes))))
    if not len(starts):
        return np.zeros(0, _U), per_text
    end = blank.copy()
    end[1:] &= ~blank[:-1]
    end[0] = False
    lens = np.flatnonzero(end) - starts
    inner = np.flatnonzero(~blank)
    first = np.cumsum(lens) - lens
    power = np.full(int(lens.max()), _POWER)
    power[0] = _U(1)
    power = np.multiply.accumulate(power)
    place = np.arange(len(inner)) - np.repeat(first, lens)
    total = np.add.reduceat((a[inner].astype(_U) + _U(1)) * power[place], first)
    return mix(total + lens.astype(_U) * _GOLD), per_text


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending. Fewer than k words: the whole sequence as one; none: empty."""
    words, per_text = word_hashes(texts)
    out: list[np.ndarray] = []
    whole = np.zeros(0, _U)
    if len(words) >= k:
        whole = np.zeros(len(words) - k + 1, _U)
        for i in range(k):
            whole += words[i : len(words) - k + 1 + i] * _STEP[i]
        whole = mix(whole)
    at = 0
    for n in per_text.tolist():
        if n >= k:
            s = np.sort(whole[at : at + n - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            few = np.array([n], _U) * _GOLD
            for i in range(n):
                few = few + words[at + i : at + i + 1] * _STEP[i]
            out.append(mix(few))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def _draw(elements: np.ndarray, layer: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The number's fraction and the place, layer .. m - 1, that this layer swaps with."""
    x = mix(elements + _U((layer + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    fraction = (x >> _U(32)).astype(np.float64) / 4294967296.0
    return fraction, layer + (((x & _U(0xFFFFFFFF)) * _U(m - layer)) >> _U(32)).astype(np.int64)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m numbers per set; rows of empty sets are infinite."""
    sizes = np.array([len(s) for s in sets])
    low = np.full((len(sets), m), np.inf)
    flat = low.reshape(-1)
    if not sizes.sum():
        return low
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    fraction, k0 = _draw(elements, 0, m)
    np.minimum.at(flat, owner * m + k0, fraction)

    def rest(*arrays: np.ndarray, layer: int) -> tuple[np.ndarray, ...]:
        going = (low.max(axis=1) >= layer)[owner_now]
        return tuple(a[going] for a in arrays)

    owner_now = owner
    elements, k0, owner_now = rest(elements, k0, owner_now, layer=1)
    if not len(elements) or m == 1:
        return low
    fraction, k1 = _draw(elements, 1, m)
    np.minimum.at(flat, owner_now * m + np.where(k1 == k0, 0, k1), 1 + fraction)
    elements, k0, k1, owner_now = rest(elements, k0, k1, owner_now, layer=2)
    # only elements of small sets come this far; their permutations are held as arrays, a bounded number at a time
    for lo in range(0, len(elements), 1 << 16):
        hi = lo + (1 << 16)
        _deeper(flat, low, elements[lo:hi], k0[lo:hi], k1[lo:hi], owner_now[lo:hi], m)
    return low


def _deeper(flat: np.ndarray, low: np.ndarray, elements: np.ndarray, k0: np.ndarray, k1: np.ndarray, owner: np.ndarray, m: int) -> None:
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    row = np.arange(len(elements))

    def swap(j: int, k: np.ndarray) -> np.ndarray:
        got = perm[row, k]
        perm[row, k] = perm[:, j]
        perm[:, j] = got
        return got.astype(np.int64)

    swap(0, k0)
    swap(1, k1)
    for j in range(2, m):
        fraction, k = _draw(elements, j, m)
        np.minimum.at(flat, owner * m + swap(j, k), j + fraction)
        # a set that lies across two blocks may only look unfinished, which costs layers but no correctness
        going = (low[owner].max(axis=1) if len(owner) < 256 else low.max(axis=1)[owner]) >= j + 1
        if not going.any():
            return
        if going.mean() < 0.7:
            elements, owner, perm = elements[going], owner[going], perm[going]
            row = np.arange(len(elements))


def band_keys(low: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of successive places, which differs between bands."""
    n, m = low.shape
    bits = mix(low.view(_U)).reshape(n, bands, m // bands)
    out = np.full((n, bands), _U(0)) + np.arange(1, bands + 1, dtype=_U) * _GOLD
    for i in range(m // bands):
        out = mix(out * _STEP[4] + bits[:, :, i])
    return out.view(np.int64)


def short(low: np.ndarray) -> np.ndarray:
    """16 bits of each place, for estimates."""
    return (mix(low.view(_U)) >> _U(48)).astype("<u2")
