"""Documents that contain benchmark items, also with small edits, by the q-gram lemma.

A document holds an item of length m within k edits only if the two share at
least ``m + 1 - q (k + 1)`` q-grams whose diagonals (position in the document
minus position in the item) lie no further than k apart. So

1. every q-gram of a document is looked up among those of the items,
2. shared q-grams are counted in overlapping bands of diagonals, each as wide
   as two edit budgets, so that any k diagonals in a row are inside of one,
3. bands that meet the bound are verified by an alignment that only computes
   the band, with a free start and end in the document.

Texts are compared in lower case with runs of white space as one space; spans
are given in characters of the text as it is. The edit budget is a share of
the item's length, at every length. The lemma asks for a q of at most
``m / (k + 1)``, so items too short for the usual q are indexed with the
largest one that it allows; with no edits that is the whole item.

Documents are not shuffled. The index of the items is broadcast if it is below
a bound in size; a larger benchmark is cut into groups below it, each of which
meets all documents.

Null and empty texts and items match nothing. Repeated documents give repeated
matches, repeated items count once (with equal ids and texts); an empty table
on either side gives an empty result. Columns other than ids and texts are not
read; the ids may be null.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.llm.common import batches, free_names, parts_for

GRAM = 8
EDITS = 0.1
INDEX_CHARS = 2_000_000
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1

MATCHES = T.ArrayType(
    T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("edits", T.LongType()),
    ])
)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (of one character) and white space, by code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    space = np.zeros(0x110000, bool)
    for c in range(0x20000):
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
        space[c] = chr(c).isspace()
    return lower, space


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces, and the position of each in ``text``."""
    lower, space = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = space[points]
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    out = np.where(blank[at], np.uint32(32), lower[points[at]])
    return out, at


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points at every position, by doubling lengths."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width = points.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if q & width:
            if out is None:
                out = part
            else:
                out = out[: len(part) - done] * np.uint64(pow(_BASE, width, 2**64)) + part[done:]
            done += width
        if width * 2 > q:
            break
        part = part[:-width] * np.uint64(pow(_BASE, width, 2**64)) + part[width:]
        width *= 2
    h = out[:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def budget(length: int, share: float) -> int:
    """Edits allowed: a share of the length, and never the whole item."""
    return max(0, min(int(share * length), length - 1))


def gram_length(length: int, edits: int, q: int) -> int:
    """The largest q up to ``q`` for which the lemma still asks for a shared q-gram."""
    return max(1, min(q, length // (edits + 1)))


@dataclasses.dataclass
class Grams:
    """q-grams of items with the same q, ascending, with the items and positions that have them."""

    q: int
    ids: list[int | None]
    items: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    bits: np.ndarray

    @classmethod
    def build(cls, ids: list[int | None], items: list[np.ndarray], q: int, share: float) -> Grams:
        edits = np.array([budget(len(p), share) for p in items], np.int64)
        need = np.array([len(p) + 1 - q * (k + 1) for p, k in zip(items, edits, strict=True)], np.int64)
        found = [grams(p, q) for p in items]
        value = np.concatenate(found)
        owner = np.repeat(np.arange(len(items)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        value, owner, place = value[order], owner[order], place[order]
        hashes, first = np.unique(value, return_index=True)
        bits = np.zeros(1 << 22, bool)
        bits[hashes >> np.uint64(42)] = True
        return cls(q, ids, items, edits, need, hashes, np.r_[first, len(value)], owner, place, bits)

    def bands(self, points: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Rows (document, item, lowest diagonal, highest diagonal) that meet the bound.

        ``points`` holds all documents one after the other, ``doc`` the document
        of each position and ``begin`` where each document begins.
        """
        value = grams(points, self.q)
        at = np.flatnonzero(self.bits[value >> np.uint64(42)])
        at = at[doc[at] == doc[at + self.q - 1]]
        none = np.zeros((0, 4), np.int64)
        if not len(at):
            return none
        slot = np.minimum(np.searchsorted(self.hashes, value[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == value[at]
        at, slot = at[same], slot[same]
        count = self.offsets[slot + 1] - self.offsets[slot]
        post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.offsets[slot], count)
        at = np.repeat(at, count)
        item = self.owner[post]
        # Diagonals are counted from the largest negative one, so they are never below 0.
        diagonal = at - begin[doc[at]] - self.place[post] + self.place.max()
        step = self.edits[item] + 1
        if not len(at):
            return none
        width = int(diagonal.max()) + 2
        low = (doc[at].astype(np.int64) * len(self.items) + item) * width
        # Band b covers [b step, (b + 2) step): each diagonal is in two bands.
        band = diagonal // step
        key = np.concatenate([low + band + 1, low + band])
        found, votes = np.unique(key, return_counts=True)
        item = found // width % len(self.items)
        enough = votes >= self.need[item]
        found, item = found[enough], item[enough]
        band = found % width - 1
        step = self.edits[item] + 1
        base = band * step - self.place.max()
        low, high = base, base + 2 * step - 1
        # Bands that overlap are one region.
        same = found // width
        new = np.ones(len(found), bool)
        new[1:] = (same[1:] != same[:-1]) | (low[1:] > high[:-1] + 1)
        first = np.flatnonzero(new)
        if not len(first):
            return none
        return np.c_[same[first] // len(self.items), item[first], low[first], np.maximum.reduceat(high, first)]


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment on diagonals low - k to high + k, if within k edits."""
    forward = _band(item, text, low - k, high - low + 2 * k + 1, k, None)
    if forward is None:
        return None
    edits, end = forward
    _, length = _band(item[::-1], text[:end][::-1], -edits, 2 * edits + 1, edits, edits)
    return edits, end - length, end


def _band(item: np.ndarray, text: np.ndarray, first: int, width: int, k: int, fixed: int | None) -> tuple[int, int] | None:
    """Fewest edits over ``width`` diagonals from ``first`` on, and the end in the text.

    The start is free, or at the diagonal with the number ``fixed``. Costs are
    kept less the number of their diagonal: skipping a character of the text
    then costs nothing more, and a running minimum does it for the whole row.
    """
    steps = np.arange(width, dtype=np.int32)
    cost = -steps
    if fixed is not None:
        cost = np.where(steps < fixed, np.int32(len(item) + width + k + 1), np.int32(-fixed))
    outside = np.full(max(0, -first), 2**32 - 1, np.uint32)
    beyond = np.full(max(0, first + width + len(item) - len(text)), 2**32 - 1, np.uint32)
    padded = np.concatenate([outside, text, beyond])[max(0, first) :]
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(item)]
    differs = (rows != item[:, None]).astype(np.int32)
    for i in range(len(item)):
        row = cost + differs[i]
        # A character of the item more than in the text: from the next diagonal.
        np.minimum(row[:-1], cost[1:] + 2, out=row[:-1])
        cost = np.minimum.accumulate(row)
        if i % 32 == 31 and (cost + steps).min() > k:
            return None
    cost = cost + steps
    best = int(np.argmin(cost))
    if cost[best] > k:
        return None
    return int(cost[best]), min(max(first + best + len(item), 0), len(text))


@dataclasses.dataclass
class Index:
    """The items of a group by the length of their q-grams: ``q`` for all but the short ones."""

    parts: list[Grams]

    @classmethod
    def build(cls, rows: list[tuple[int | None, str]], q: int, share: float) -> Index:
        by_q: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for item_id, text in rows:
            points = normalise((text or "").strip())[0]
            if len(points):
                by_q.setdefault(gram_length(len(points), budget(len(points), share), q), []).append((item_id, points))
        return cls([Grams.build([i for i, _ in own], [p for _, p in own], n, share) for n, own in sorted(by_q.items())])


def find(index: Index, texts: list[str]) -> list[list[tuple]]:
    """For each text the matches (item_id, start, end, edits), overlapping ones of an item as the best one."""
    normal = [normalise(t) for t in texts]
    lengths = np.array([len(p) for p, _ in normal], np.int64)
    points = np.concatenate([*(p for p, _ in normal), np.zeros(0, np.uint32)])
    doc = np.repeat(np.arange(len(texts)), lengths)
    begin = np.cumsum(lengths) - lengths
    found: list[list[tuple]] = [[] for _ in texts]
    first = 0
    for part in index.parts:
        for d, i, low, high in part.bands(points, doc, begin).tolist():
            text, k = normal[d][0], int(part.edits[i])
            a = max(0, low - k)
            hit = banded(part.items[i], text[a : high + 2 * k + len(part.items[i]) + 1], low - a, high - a, k)
            if hit:
                found[d].append((first + i, hit[1] + a, hit[2] + a, hit[0]))
        first += len(part.items)
    ids = [item_id for part in index.parts for item_id in part.ids]
    out = []
    for hits, (_, at) in zip(found, normal, strict=True):
        best: list[tuple] = []
        for hit in sorted(set(hits)):
            if best and best[-1][0] == hit[0] and hit[1] < best[-1][2]:
                best[-1] = min(best[-1], hit, key=lambda h: (h[3], h[1]))
            else:
                best.append(hit)
        out.append([(ids[i], int(at[a]), int(at[b - 1]) + 1, e) for i, a, b, e in best])
    return out


def _groups(benchmark: DataFrame, index_chars: int) -> Iterator[list[tuple]]:
    """Items in groups whose indexes are below the bound (an item of its own beyond it, if larger)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = parts_for(total, index_chars, 1)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for number in range(parts if total else 0):
        group: list[tuple] = []
        size = 0
        for row in sorted(rows.where(part == number).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text)):
            if group and size + len(row.text) > index_chars:
                yield group
                group, size = [], 0
            group.append((row.item_id, row.text))
            size += len(row.text)
        if group:
            yield group


def with_matches(docs: DataFrame, benchmark: DataFrame, to: str = "matches", share: float = EDITS, q: int = GRAM, index_chars: int = INDEX_CHARS) -> DataFrame:
    """``docs`` and an array of (item_id, start, end, edits) of what each document contains.

    A column that has the name ``to`` already is replaced. Nothing is shuffled.
    """
    spark = docs.sparkSession
    wide = docs.drop(to)
    empty = F.lit(None).cast(MATCHES)
    out = wide.withColumn(to, F.coalesce(empty, F.array().cast(MATCHES)))
    for group in _groups(benchmark, index_chars):
        shared = spark.sparkContext.broadcast(Index.build(group, q, share))
        out = out.mapInArrow(_lookup(shared, to), out.schema)
    return out


def _lookup(shared, to: str):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, CHUNK):
            texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
            at = batch.schema.names.index(to)
            kind = batch.schema.field(at).type
            before = batch.column(at).to_pylist()
            names = ("item_id", "start", "end", "edits")
            new = [
                [*old, *(dict(zip(names, hit, strict=True)) for hit in hits)]
                for old, hits in zip(before, find(shared.value, texts), strict=True)
            ]
            columns = list(batch.columns)
            columns[at] = pa.array(new, kind)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row (doc_id, item_id, start, end, edits) per item found in a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_matches(rows, benchmark, "matches", **options)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.end", "m.edits")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    [to] = free_names(docs.columns, "benchmark_matches_")
    return with_matches(docs, benchmark, to, **options).where(F.size(to) == 0).drop(to)
