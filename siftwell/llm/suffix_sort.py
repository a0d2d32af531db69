"""Suffix arrays by induced sorting, one shard at a time, in whole-array steps.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour.
The substrings between leftmost S positions are sorted by induction from their
first signs and named; the string of names is sorted one level up, pair of
names by pair of names, until ranks are settled over ``reach`` signs; from the
sorted leftmost S suffixes one more induction sorts all suffixes. An induction
goes through the buckets of first signs in order and moves, for all entries of
a bucket at once, the suffixes one to the left into theirs; runs of one sign
take a step per repetition.

Common prefixes are computed in text order: only where the sign to the left
differs from that of the neighbour in suffix order ("irreducible") are signs
compared; every other value is one less than the one before it.
"""

from __future__ import annotations

import numpy as np


def smaller(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last sign must be the only smallest one."""
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.r_[np.r_[step, 1][following] > 0, True]


def induce(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffixes in the order induced by the given order of the leftmost S positions."""
    sizes = np.bincount(t)
    end = np.cumsum(sizes)
    start = end - sizes
    sa = np.full(len(t), -1, np.int64)

    def grouped(at: np.ndarray):
        """Stable by sign: positions, their signs, their numbers within the sign."""
        signs = t[at]
        order = np.argsort(signs, kind="stable")
        at, signs = at[order], signs[order]
        count = np.bincount(signs, minlength=len(sizes))
        return at, signs, np.arange(len(at)) - (np.cumsum(count) - count)[signs], count

    at, signs, place, seed_count = grouped(seeds)
    sa[(end - seed_count)[signs] + place] = at

    head = start.copy()

    def to_left(q: np.ndarray) -> None:
        q = q[q > 0] - 1
        q = q[~is_s[q]]
        if len(q):
            at, signs, place, count = grouped(q)
            sa[head[signs] + place] = at
            np.add(head, count, out=head)

    signs_used = np.flatnonzero(sizes)
    for c in signs_used:
        low = start[c]
        while low < head[c]:
            q, low = sa[low : head[c]], head[c]
            to_left(q)
        to_left(sa[end[c] - seed_count[c] : end[c]])

    tail = end.copy()

    def to_right(q: np.ndarray) -> None:
        q = q[q > 0] - 1
        q = q[is_s[q]]
        if len(q):
            at, signs, place, count = grouped(q)
            sa[tail[signs] - 1 - place] = at
            np.subtract(tail, count, out=tail)

    for c in signs_used[::-1]:
        high = end[c]
        while high > tail[c]:
            q, high = sa[tail[c] : high][::-1], tail[c]
            to_right(q)
        to_right(sa[start[c] : head[c]][::-1])
    sa[0] = len(t) - 1  # the closing sign, to which nothing leads
    return sa


def suffix_array(t: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of t by their first ``reach`` signs at least.

    t holds small non-negative numbers and ends with its only smallest one.
    """
    is_s = smaller(t)
    is_left = is_s.copy()
    is_left[0] = False
    is_left[1:] &= ~is_s[:-1]
    left = np.flatnonzero(is_left)
    if len(left) < 2:
        return induce(t, is_s, left)
    order = induce(t, is_s, left)
    order = order[is_left[order]]
    number = np.full(len(t), -1, np.int64)
    number[left] = np.arange(len(left))
    length = np.diff(np.r_[left, len(t) - 1])
    # Names: a substring is new unless it equals the one before it.
    size = length[number[order]]
    new = np.r_[True, size[1:] != size[:-1]]
    live = np.flatnonzero(~new)
    closing = np.append(t, np.zeros(1, t.dtype))
    offset = 0
    while len(live):
        differs = closing[order[live] + offset] != closing[order[live - 1] + offset]
        new[live[differs]] = True
        live = live[~differs]
        live = live[size[live] > offset]
        offset += 1
    names = np.empty(len(left), np.int64)
    names[number[order]] = np.cumsum(new)
    # One level up: pairs of names, then pairs of pairs.
    width, shortest = 1, 2  # a substring spans at least two signs
    while names.max() < len(names) and width * shortest < 2 * reach:
        second = np.r_[names[width:], np.zeros(min(width, len(names)), np.int64)][: len(names)]
        pair = names * (len(names) + 1) + second
        rank = np.argsort(pair, kind="stable")
        names[rank] = np.cumsum(np.r_[True, pair[rank][1:] != pair[rank][:-1]])
        width *= 2
    return induce(t, is_s, left[np.argsort(names, kind="stable")])


def permuted_prefixes(raw: np.ndarray, sa: np.ndarray, left_in: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, in text order.

    raw: the bytes; left_in: bytes left in the suffix's own string, which the
    prefix never exceeds (0 at the signs between strings); most: its maximum.
    """
    n = len(raw)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = sa[0]
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = np.r_[True, (raw[:-1] != raw[np.maximum(phi[1:] - 1, 0)]) | (phi[1:] == 0)]
    fresh[1:] |= (left_in[:-1] == 0) | (left_in[np.maximum(phi[1:] - 1, 0)] == 0)
    padded = np.r_[raw, np.zeros(most + 16, np.uint8)]
    words = np.ndarray((n + most + 8,), "<u8", padded.data, strides=(1,))
    at = np.flatnonzero(fresh)
    value = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for k in range(0, most + 1, 8):
        x = words[at[live] + k] ^ words[phi[at[live]] + k]
        zero = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        value[live] = k + zero
        live = live[x == 0]
        if not len(live):
            break
    value = np.minimum(value, np.minimum(left_in[at], left_in[phi[at]]))
    value[phi[at] == at] = 0
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    full = np.zeros(n, np.int64)
    full[at] = value
    return np.maximum(full[last] - (i - last), 0)


def repeated_windows(strings: list[bytes], size: int) -> list[np.ndarray]:
    """Per string, which windows of ``size`` bytes also start elsewhere in the strings."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    t = raw.astype(np.uint16) + 2
    t[ends] = 1
    t[-1] = 0
    left_in = np.zeros(len(t), np.int64)
    begin = ends - lengths
    left_in[: ends[-1] + 1] = np.repeat(ends, lengths + 1) - np.arange(ends[-1] + 1)
    most = int(lengths.max())
    sa = suffix_array(t, most)
    prefix = permuted_prefixes(raw, sa, left_in, most)[sa] >= size
    found = np.zeros(len(t), bool)
    found[sa] = prefix | np.r_[prefix[1:], False]
    return [found[b : b + max(0, n - size + 1)] for b, n in zip(begin, lengths)]
