"""Re-Pair grammars of integer sequences, in numpy: pairs of neighbouring symbols are replaced until none occurs twice.

Rounds take the pairs in order of frequency: each round all pairs that occur at least a thirty-second as often as the most
frequent one, then all that occur twice, until there are none. Of occurrences that overlap, the one of the more
frequent pair stays. A pair that keeps fewer than two occurrences that way gets no rule in this round. There is no
bound on rounds or rules.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Below this frequency all pairs that occur twice are taken, by places whose pairs can still do so.
FEW = 64


def _apart(at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Occurrences (sorted by group and place) that don't overlap another of their own pair: of a run every second goes."""
    touch = np.zeros(len(at), bool)
    touch[1:] = (at[1:] - at[:-1] == 1) & (group[1:] == group[:-1])
    if not touch.any():
        return ~touch
    run = np.flatnonzero(~touch)
    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return nth % 2 == 0


def _settle(rank: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which occurrences (sorted by place) are replaced; rank: of each group, the lower the better.

    An occurrence wins if no better one that can still win touches it. Groups with fewer than two winners leave, and
    what they kept from winning is tried again, so every occurrence of a group that stays is replaced or destroyed.
    """
    n, worst = len(at), np.int32(2**31 - 1)
    near = np.zeros(n + 1, bool)  # near[i]: occurrence i touches i - 1
    np.equal(at[1:] - at[:-1], 1, out=near[1:n])
    mine = np.full(n + 2, worst)
    mine[1:-1] = rank[group]
    me = mine[1:-1]
    # the first look, at all of them
    won = np.zeros(n + 2, bool)
    won[1:-1] = ((me < mine[:-2]) | ~near[:-1]) & ((me <= mine[2:]) | ~near[1:])
    lost = (won[:-2] & near[:-1]) | (won[2:] & near[1:])
    lost |= won[1:-1]
    alive = np.flatnonzero(~lost).astype(np.int32)
    kept = mine[alive + 1]
    mine[:] = worst
    mine[alive + 1] = kept
    while True:
        while len(alive):
            left = np.where(near[alive], mine[alive], worst)
            right = np.where(near[alive + 1], mine[alive + 2], worst)
            me = mine[alive + 1]
            w = alive[(me < left) & (me <= right)]
            won[w + 1] = True
            mine[w + 1] = worst
            lost = np.concatenate([w[near[w]] - 1, w[near[w + 1]] + 1])
            mine[lost + 1] = worst
            alive = alive[mine[alive + 1] != worst]
        size = np.bincount(group[won[1:-1]], minlength=len(rank))
        if not (size == 1).any():
            return won[1:-1]
        won[1:-1] &= (size != 1)[group]
        free = (size >= 2)[group] & ~won[1:-1]
        free &= ~(near[:-1] & won[:-2]) & ~(near[1:] & won[2:])
        alive = np.flatnonzero(free).astype(np.int32)
        mine[alive + 1] = rank[group[alive]]


def _pairs(seq: np.ndarray, at: np.ndarray | None, symbols: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (left << side | right) at the places (None: all), the places, in order of pair and place; the side."""
    side, bits = max(1, (symbols - 1).bit_length()), max(1, len(seq).bit_length())
    key = seq[:-1].astype(_U) if at is None else seq[at].astype(_U)
    if 2 * side + bits <= 64:  # in one number, which sorts fastest
        key <<= _U(side)
        key |= seq[1:] if at is None else seq[at + 1]
        key <<= _U(bits)
        key |= np.arange(len(key), dtype=_U) if at is None else at.astype(_U)
        key.sort()
        at = (key & _U((1 << bits) - 1)).astype(np.int32)
        key >>= _U(bits)
        return key, at, side
    key <<= _U(32)
    key |= seq[1:] if at is None else seq[at + 1]
    order = np.argsort(key, kind="stable")
    return key[order], order.astype(np.int32) if at is None else at[order], 32


def compress(seq: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols; rule k makes symbol base + k) and the sequence in which no pair occurs twice without overlap.

    Once all pairs are taken that occur twice, only places beside new symbols are looked at, and those that remain of
    the pairs just taken: a pair that occurs once never comes to occur twice, for only new symbols make new pairs.
    """
    seq, symbols, rules = seq.astype(np.uint32), base, []
    at: np.ndarray | None = None
    rest = False
    while len(seq) > 1 and (at is None or len(at)):
        key, place, side = _pairs(seq, at, symbols)
        start = np.flatnonzero(key[1:] != key[:-1])
        start += 1
        start = np.append(np.append(0, start), len(key))
        counts = np.diff(start)
        most = int(counts.max())
        rest = rest or most < FEW
        least = 2 if rest else max(FEW, most // 32)
        often = counts >= least
        if not often.any():
            break
        pairs, counts = key[start[:-1][often]], counts[often]
        place = place[np.repeat(often, np.diff(start))]
        group = np.repeat(np.arange(len(pairs), dtype=np.int32), counts)
        left, right = pairs >> _U(side), pairs & _U((1 << side) - 1)
        every = place
        own = np.flatnonzero(left == right)  # only a pair of equal symbols can overlap itself
        if len(own):
            mine = np.flatnonzero((left == right)[group])
            ok = np.ones(len(place), bool)
            ok[mine] = _apart(place[mine], group[mine])
            place, group = place[ok], group[ok]
            counts = np.bincount(group, minlength=len(pairs))
        order = np.sort(((counts.max() - counts).astype(_U) << _U(32)) | np.arange(len(pairs), dtype=_U)).astype(np.uint32)
        rank = np.empty(len(pairs), np.int32)  # most frequent first, ties by the pair
        rank[order] = np.arange(len(pairs), dtype=np.int32)
        of = np.full(len(seq), -1, np.int32)  # the group of each place
        of[place] = group
        place = np.flatnonzero(of >= 0).astype(np.int32)
        group = of[place]
        won = _settle(rank, place, group)
        hit, group = place[won], group[won]
        used = np.bincount(group, minlength=len(pairs)) > 0
        if len(hit):
            name = (symbols - 1 + np.cumsum(used)).astype(np.uint32)
            symbols += int(used.sum())
            rules.append(np.stack([left[used], right[used]], axis=1).astype(np.uint32))
            seq[hit] = name[group]
        elif rest:
            break
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        short = seq[keep]
        if rest:
            moved = np.cumsum(keep, dtype=np.int32)
            moved -= 1
            new = moved[hit]
            touched = np.zeros(len(seq) + 1, bool)
            touched[hit] = touched[hit + 1] = True
            left_over = every[~(touched[every] | touched[every + 1])]
            mark = np.zeros(len(short) + 1, bool)
            mark[new] = True
            mark[new[new > 0] - 1] = True
            mark[moved[left_over]] = True
            at = np.flatnonzero(mark[: len(short) - 1]).astype(np.int32)
        else:
            rest = len(short) > 0.98 * len(seq)  # little to do for another such round
        seq = short
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq
