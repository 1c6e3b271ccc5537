"""Two-stage suffix sorting of a byte string, in NumPy.

Only suffixes smaller than their successors are sorted directly; all others
are induced from them by one scan over the buckets of first bytes. Order is
exact for the first ``DEPTH`` bytes, which is what finding repeats of up to
that length needs: suffixes that agree so far stand together in any order.
Where only some suffixes are wanted, only they and those that they are induced
from are sorted.
"""

from __future__ import annotations

import numpy as np

WORD = 8
DEPTH = 56


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as a big-endian number, zeros behind the end.

    A view with a stride of one byte: nothing is copied until it is indexed.
    """
    padded = np.concatenate([text, np.zeros(DEPTH + 2 * WORD, np.uint8)])
    return np.ndarray((len(text) + DEPTH + WORD,), ">u8", padded, 0, (1,))


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later."""
    out = np.zeros(len(text), bool)
    np.greater(text[1:], text[:-1], out=out[:-1])  # the last suffix is larger than the empty one
    # Inside a run of equal bytes, the first different byte behind it decides.
    equal = np.flatnonzero(text[1:] == text[:-1])
    last = np.flatnonzero(np.r_[np.diff(equal) > 1, True][: len(equal)])
    out[equal] = np.repeat(out[equal[last] + 1], np.diff(np.r_[-1, last]))
    return out


def _with_successors(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The wanted suffixes and all that these are induced from: the successors, up to one that is sorted directly."""
    needed = wanted.copy()
    at = np.flatnonzero(needed & ~smaller)
    while len(at):
        at = at[at < len(needed) - 1] + 1
        at = at[~needed[at]]
        needed[at] = True
        at = at[~smaller[at]]
    return needed


def _within(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by group, then by key; a stable sort of 16 bits takes time in proportion."""
    order = np.argsort(key)
    group = group - group[0]
    for shift in range(0, int(group[-1]).bit_length(), 16):
        part = (group[order] >> shift).astype(np.uint16)
        order = order[np.argsort(part, kind="stable")]
    return order


def _sort_directly(positions: np.ndarray, view: np.ndarray) -> np.ndarray:
    """Positions in the order of their first DEPTH bytes: a word at a time, ties only."""
    key = view[positions].astype(np.uint64)
    order = np.argsort(key)
    positions, key = positions[order], key[order]
    new = np.ones(len(positions), bool)
    new[1:] = key[1:] != key[:-1]
    for depth in range(WORD, DEPTH, WORD):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        key = view[positions[at] + depth].astype(np.uint64)
        order = _within(group, key)
        positions[at], key = positions[at][order], key[order]
        new[at[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    return positions


def suffix_order(text: np.ndarray, view: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """All positions of ``text``, or those that a mask marks as wanted, in the order of their suffixes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    if view is None:
        view = words(text)
    smaller = smaller_than_successor(text)
    needed = np.ones(n, bool) if wanted is None else _with_successors(wanted, smaller)
    direct = _sort_directly(np.flatnonzero(smaller & needed), view)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[-1]:
        waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        if not waiting[byte] and ends[byte] == ends[byte + 1]:
            continue
        # Induced suffixes come first: those followed by a smaller byte, then
        # those followed by one, two, ... more of the bucket's own byte.
        bucket = []
        found = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        while len(found):
            bucket.append(found)
            before = found[found > 0] - 1
            found = before[(text[before] == byte) & needed[before]]
        bucket.append(direct[ends[byte] : ends[byte + 1]])
        scan = np.concatenate(bucket)
        out.append(scan)
        before = scan[scan > 0] - 1
        first = text[before]
        larger = (first > byte) & needed[before]
        before, first = before[larger], first[larger]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(first)], strict=True):
                waiting[first[a]].append(before[a:b])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(order: np.ndarray, view: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, up to DEPTH; 0 for the first."""
    lengths = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for depth in range(0, DEPTH, WORD):
        other = view[order[alive] + depth].astype(np.uint64) ^ view[order[alive - 1] + depth].astype(np.uint64)
        same = other == 0
        ended, other = alive[~same], other[~same]
        more = np.zeros(len(ended), np.int64)
        for k in range(1, WORD):
            more += other < np.uint64(1 << (64 - 8 * k))
        lengths[ended] += more
        alive = alive[same]
        lengths[alive] += WORD
        if not len(alive):
            break
    return lengths
