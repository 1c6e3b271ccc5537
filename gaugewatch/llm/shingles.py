"""Word shingles of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_CODE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up = np.full(count, np.uint64(_BASE))
    down = np.full(count, np.uint64(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the text's number; A-Z is lower-cased."""
    values, owner = prefix_hashes(texts, ())
    return values[0], owner


def prefix_hashes(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of every word, and of its first bytes for each of ``lengths``; and the text's number.

    A word has the hash of a prefix only if it is longer; else its own.
    """
    joined = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    space = SPACE[joined]
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in range(len(lengths) + 1)], np.zeros(0, np.int64)
    up, down = powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.multiply(_CODE[joined], up[:-1], out=sums[1:])
    np.cumsum(sums, out=sums)
    values = [mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))]
    for n in lengths:
        short = np.minimum(begin + n, end)
        value = mix((sums[short] - sums[begin]) * down[begin] + np.uint64(n << 32))
        values.append(np.where(short < end, value, values[0]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return values, np.searchsorted(ends, begin, "right")


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ascending inside each; and offsets, one more than texts.

    A text with fewer words is one shingle, a text without words none.
    """
    value, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    h = np.zeros(len(doc), np.uint64)
    padded = np.r_[value, np.zeros(words, np.uint64)]
    width = np.minimum(counts, words)[doc]
    for k in range(words):
        h = mix(h + np.where(k < width, padded[at + k], np.uint64(0)) + np.uint64(k + 1))
    h = mix(h + width.astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int64)
