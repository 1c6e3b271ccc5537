"""Vector work inside a task; imports nothing of Spark, so that workers start fast."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMALL_PAIRS = 1 << 14
DIRECT_PAIRS = 1 << 18
LEAF_ROWS = 256
BOX_ROWS = 16
TILE = 1024  # patterns of one product: it stays in a core's cache
# Squares that single precision holds.
THIN_LEAST, THIN_MOST = 1e-20, 1e30


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as a float64 matrix; all must be there and of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return np.empty((0, 0))
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("embeddings differ in size")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def usable_rows(column: pa.ChunkedArray | pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and matrix of the rows that are lists of ``size`` finite values.

    Without a size, that of the first list that is not NULL or empty counts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(pc.fill_null(pc.list_value_length(column), -1), dtype="int64")
    if size is None:
        size = int(lengths[lengths > 0][0]) if (lengths > 0).any() else 0
    fit = np.flatnonzero(lengths == size)
    values = matrix(column.take(pa.array(fit))) if len(fit) and size else np.empty((len(fit), size))
    finite = np.isfinite(values).all(1)
    return (fit, values) if finite.all() else (fit[finite], values[finite])


def squared_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise squared distance, summed from the first dimension to the last."""
    total = np.zeros(len(a))
    for at in range(0, len(a), TILE):
        diff = np.ascontiguousarray((a[at : at + TILE] - b[at : at + TILE]).T)
        diff *= diff
        for one in diff:
            total[at : at + TILE] += one
    return total


def best_places(rows: np.ndarray, ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest (distance, id) within each row number."""
    if not len(rows):
        return np.empty(0, np.int64)
    order = np.argsort(distances)
    least = int(rows.min())
    # A stable sort of 16 bits takes time in proportion.
    for shift in range(0, max(1, int(rows.max() - least).bit_length()), 16):
        order = order[np.argsort(((rows[order] - least) >> shift).astype(np.uint16), kind="stable")]
    row, far = rows[order], distances[order]
    new = row[1:] != row[:-1]
    tied = ~new & (far[1:] == far[:-1])
    if tied.any():
        at = np.flatnonzero(np.r_[tied, False] | np.r_[False, tied])
        order[at] = order[at][np.lexsort((ids[order[at]], far[at], row[at]))]
    place = np.arange(len(order))
    return order[place - np.maximum.accumulate(np.where(np.r_[True, new], place, 0)) < k]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def joined(parts: list[Found]) -> Found:
    if not parts:
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
    return tuple(np.concatenate(part) for part in zip(*parts))


class Arena(NamedTuple):
    """Patterns that queries meet.

    ``thin`` holds vectors in single precision, with minus half their square as
    a last value, so that one product gives what queries are ranked by. ``wide``
    holds doubles, and nothing where ``thin`` has the very same values.
    """

    wide: np.ndarray | None
    half: np.ndarray
    thin: np.ndarray | None
    top: float
    size: int

    def take(self, places: np.ndarray) -> np.ndarray:
        return self.wide[places] if self.wide is not None else self.thin[places][:, :-1].astype(np.float64)


def arena_of(vectors: np.ndarray | Arena) -> Arena:
    if isinstance(vectors, Arena):
        return vectors
    half = 0.5 * np.einsum("ij,ij->i", vectors, vectors)
    top = 2.0 * float(half.max(initial=0.0))
    rows, size = vectors.shape
    if not rows or not top < THIN_MOST:
        return Arena(vectors, half, None, top, size)
    thin = np.empty((rows, size + 1), np.float32)
    thin[:, :-1], thin[:, -1] = vectors, -half
    return Arena(None if (thin[:, :-1] == vectors).all() else vectors, half, thin, top, size)


def _pair_distances(q: np.ndarray, rows: np.ndarray, arena: Arena, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs; only a tile of pairs is held as vectors at once."""
    far = np.empty(len(rows))
    for at in range(0, len(rows), TILE):
        far[at : at + TILE] = squared_rows(q[rows[at : at + TILE]], arena.take(cols[at : at + TILE]))
    return far


def _true_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.nonzero`` of a matrix with few true places: eight are looked at together."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    at, nth = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.divmod(np.r_[some[at] * 8 + nth, whole + np.flatnonzero(flat[whole:])], mask.shape[1])


def _passing(q: np.ndarray, own: np.ndarray, limit: np.ndarray, arena: Arena, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query place, pattern place) of all pairs within ``limit``, and of some that are a little farther.

    A product in single precision is off by less than an eighth of ``slack``; where
    that is much against the limits, doubles are used.
    """
    scale = 8.0 * (q.shape[1] + 8) * (own.max() + arena.top)
    middle = np.median(limit)
    thin = arena.thin is not None and own.max() < THIN_MOST and THIN_LEAST < middle < np.inf
    thin = thin and scale * np.finfo(np.float32).eps <= 0.02 * middle
    kind = np.float32 if thin else np.float64
    slack = scale * np.finfo(kind).eps
    with np.errstate(over="ignore"):
        left, floor = q.astype(kind, copy=False), (0.5 * (own - limit - slack)).astype(kind)[:, None]
    if thin:
        left = np.c_[left, np.ones(len(q), kind)]
    rows, places = [], []
    for at in range(0, len(cols), TILE):
        some = cols[at : at + TILE]
        if thin:
            # Patterns that lie together need no copy.
            whole = some[-1] - some[0] == len(some) - 1 and (np.diff(some) == 1).all()
            score = left @ arena.thin[slice(some[0], some[-1] + 1) if whole else some].T
        else:
            score = left @ arena.take(some).T
            score -= arena.half[some]
        r, c = _true_places(score >= floor)
        rows.append(r)
        places.append(some[c])
    return np.concatenate(rows), np.concatenate(places)


def _first_limits(
    qid: np.ndarray, q: np.ndarray, own: np.ndarray, limit: np.ndarray, arena: Arena, vid: np.ndarray, cols: np.ndarray, k: int,
    exclude_self: bool,
) -> np.ndarray:
    """Limits that the ``k`` nearest of the first patterns surely keep, for queries that have none yet."""
    some = cols[: 4 * LEAF_ROWS]
    if len(some) <= k:
        return limit
    score = q @ arena.take(some).T - arena.half[some]
    if exclude_self:
        score[qid[:, None] == vid[some][None, :]] = -np.inf
    kth = np.partition(score, len(some) - k, axis=1)[:, len(some) - k]
    slack = 8.0 * (q.shape[1] + 8) * (own.max() + arena.top) * np.finfo(float).eps
    # Not a number where squares overflow.
    return np.fmin(limit, own - 2.0 * kth + slack)


def _near_pairs(
    qid: np.ndarray, q: np.ndarray, own: np.ndarray, limit: np.ndarray, arena: Arena, vid: np.ndarray, cols: np.ndarray, k: int,
    exclude_self: bool, free: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> Found:
    """All that may be among the best ``k`` of the patterns at ``cols`` and lies within ``limit``."""
    near = limit if free is not None or np.isfinite(limit).all() else _first_limits(qid, q, own, limit, arena, vid, cols, k, exclude_self)
    r, c = _passing(q, own, near, arena, cols)
    if exclude_self:
        other = qid[r] != vid[c]
        r, c = r[other], c[other]
    if free is not None:
        kept = free(r, c)
        r, c = r[kept], c[kept]
    exact = _pair_distances(q, r, arena, c)
    near = (exact <= limit[r]) & np.isfinite(exact)
    return r[near], c[near], exact[near]


def _best_of(held: Found, more: Found, ids: np.ndarray, limit: np.ndarray, k: int) -> Found:
    """The best ``k`` of both for every query; ``limit`` falls to each query's k-th distance."""
    if not len(more[0]):
        return held
    row, col, far = joined([held, more])
    keep = best_places(row, ids[col], far, k)
    row, col, far = row[keep], col[keep], far[keep]
    counts = np.bincount(row, minlength=len(limit))
    full = counts >= k
    limit[full] = np.minimum(limit[full], far[np.cumsum(counts)[full] - 1])
    return row, col, far


def _meet(
    qid: np.ndarray, q: np.ndarray, own: np.ndarray, limit: np.ndarray, arena: Arena, vid: np.ndarray, cols: np.ndarray, k: int,
    exclude_self: bool, free: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, held: Found,
) -> Found:
    """The best of ``held`` and of the patterns at ``cols``; ``limit`` falls to each query's k-th distance."""
    return _best_of(held, _near_pairs(qid, q, own, limit, arena, vid, cols, k, exclude_self, free), vid, limit, k)


def nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray | Arena, k: int, exclude_self: bool
) -> Found:
    """Exact top ``k`` as (query place, pattern place, squared distance).

    A matrix product narrows down, the difference form decides. Only tiles of
    products are held at once, whatever the number of patterns.
    """
    if not len(ids) or not len(query_ids):
        return joined([])
    arena = arena_of(vectors)
    if queries.shape[1] != arena.size:
        raise ValueError(f"query size {queries.shape[1]} differs from pattern size {arena.size}")
    out = []
    for at in range(0, len(query_ids), LEAF_ROWS):
        q, qid = queries[at : at + LEAF_ROWS], query_ids[at : at + LEAF_ROWS]
        own, limit, held = (q * q).sum(1), np.full(len(q), np.inf), joined([])
        place, take = 0, 2 * LEAF_ROWS
        while place < len(ids):
            cols = np.arange(place, min(place + take, len(ids)))
            held = _meet(qid, q, own, limit, arena, ids, cols, k, exclude_self, None, held)
            place, take = place + take, 4 * take
        out.append((at + held[0], held[1], held[2]))
    return joined(out)


class Codes(NamedTuple):
    """Coded patterns in the order of their cells: the places of cell ``c`` begin at ``starts[c]``."""

    ids: np.ndarray
    codes: np.ndarray
    starts: np.ndarray


def nearest_codes(
    query_ids: np.ndarray, queries: np.ndarray, probed: np.ndarray, first: np.ndarray, store: Codes, centres: np.ndarray,
    codebooks: np.ndarray, k: int, exclude_self: bool, at_once: int = LEAF_ROWS, held_bytes: int = 8 << 20,
) -> Found:
    """Top ``k`` by the distance to what the codes stand for, among the cells that ``probed`` marks for each query.

    The distance to a code's entries, added up over the sub-spaces, is that to
    the vector they make up. Some of these are made at once, and queries meet
    them as in ``nearest``: ``at_once`` queries together, those of one ``first``
    cell side by side, and that cell before the others.
    """
    turn = np.argsort(first, kind="stable")
    groups = [turn[at : at + at_once] for at in range(0, len(turn), at_once)]
    limits, held = [np.full(len(rows), np.inf) for rows in groups], [joined([])] * len(groups)
    size = centres.shape[1]
    most = max(TILE, held_bytes // (8 * size))
    for nearest_ones in (True, False):
        for cell in np.flatnonzero(np.diff(store.starts)):
            asks = []
            for g, rows in enumerate(groups):
                some = np.flatnonzero(probed[rows, cell] & ((first[rows] == cell) == nearest_ones))
                if len(some):
                    asks.append((g, some, queries[rows[some]] - centres[cell]))
            if not asks:
                continue
            place, end, take = store.starts[cell], store.starts[cell + 1], TILE if nearest_ones else most
            while place < end:
                upto = min(place + take, end)
                made = np.concatenate([book[code] for book, code in zip(codebooks, store.codes[place:upto].T)], axis=1)
                arena, ids, cols = arena_of(made), store.ids[place:upto], np.arange(upto - place)
                for g, some, rest in asks:
                    limit = limits[g][some]
                    own = (rest * rest).sum(1)
                    r, c, far = _near_pairs(query_ids[groups[g][some]], rest, own, limit, arena, ids, cols, k, exclude_self)
                    held[g] = _best_of(held[g], (some[r], place + c, far), store.ids, limits[g], k)
                place, take = upto, min(4 * take, most)
    return joined([(rows[r], c, far) for rows, (r, c, far) in zip(groups, held)])


def leaves(vectors: np.ndarray, size: int = LEAF_ROWS) -> list[np.ndarray]:
    """Places of the rows in groups of at most ``size``: halved at the middle of their widest dimension, again and again."""
    done, waiting = [], [np.arange(len(vectors))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = vectors[rows]
        widest = part[:, int((part.max(0) - part.min(0)).argmax())]
        order = np.argpartition(widest, len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def nearest_in_leaves(
    query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
    exclude_self: bool, barred: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, at_once: int = 1 << 13,
) -> Found:
    """Exact top ``k`` of distances up to ``kth``, a number for each query; pairs that ``barred`` marks do not count.

    Queries and patterns lie in small boxes. A box of queries meets the boxes of
    patterns in the order of their distance, until that exceeds what its
    queries have found. ``at_once`` patterns are met before that is looked at
    again; products narrow down as in ``nearest``.
    """
    if not len(ids) or not len(query_ids):
        return joined([])
    if queries.shape[1] != vectors.shape[1]:
        raise ValueError(f"query size {queries.shape[1]} differs from pattern size {vectors.shape[1]}")
    parts = leaves(vectors)
    order = np.concatenate(parts)
    ends = np.cumsum([len(part) for part in parts])
    starts = np.r_[0, ends[:-1]]
    v, vid = vectors[order], ids[order]
    low, high = np.minimum.reduceat(v, starts, 0), np.maximum.reduceat(v, starts, 0)
    arena = arena_of(v)
    del v
    most, out = max(1, at_once // LEAF_ROWS), []
    for rows, gap in _boxes(queries, kth, low, high):
        q, qid, limit = queries[rows], query_ids[rows], kth[rows].astype(np.float64)
        own = (q * q).sum(1)
        turn = np.argsort(gap, kind="stable")
        held = joined([])
        place, take = 0, min(2, most)

        def free(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            return ~barred(rows[r], order[c])

        while place < len(turn) and gap[turn[place]] <= limit.max():
            some = turn[place : place + take]
            some = some[gap[some] <= limit.max()]
            place, take = place + take, min(4 * take, most)
            cols = np.concatenate([np.arange(starts[leaf], ends[leaf]) for leaf in some])
            held = _meet(qid, q, own, limit, arena, vid, cols, k, exclude_self, free if barred is not None else None, held)
        out.append((rows[held[0]], order[held[1]], held[2]))
    return joined(out)


def _boxes(queries: np.ndarray, kth: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of queries with the least distance of each box of patterns to them.

    A group is halved as long as that spares a good part of what it has to meet:
    few queries among many patterns lie in large boxes.
    """

    def gaps(rows: np.ndarray) -> np.ndarray:
        q = queries[rows]
        gap = np.maximum(np.maximum(low - q.max(0), q.min(0) - high), 0.0)
        return (gap * gap).sum(1) * (1 - 1e-9)

    def work(rows: np.ndarray, gap: np.ndarray) -> int:
        # A group costs as much as some queries more, whatever its size.
        return (len(rows) + BOX_ROWS) * int((gap <= kth[rows].max()).sum())

    waiting = [(rows, gaps(rows)) for rows in leaves(queries)]
    while waiting:
        rows, gap = waiting.pop()
        if len(rows) > 2 * BOX_ROWS and (cost := work(rows, gap)) > 4 * len(rows):
            halves = [(rows[part], gaps(rows[part])) for part in leaves(queries[rows], -(-len(rows) // 2))]
            if sum(work(*half) for half in halves) < 0.8 * cost:
                waiting += halves
                continue
        yield rows, gap


def hit_table(query_ids: np.ndarray, pattern_ids: np.ndarray, distances: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "query_id": pa.array(query_ids, pa.int64()),
            "pattern_id": pa.array(pattern_ids, pa.int64()),
            "distance": pa.array(distances, pa.float64()),
        }
    )


def rows_by_key(keys: list) -> dict:
    groups: dict = {}
    for i, key in enumerate(keys):
        if key is not None:
            groups.setdefault(key, []).append(i)
    return {key: np.array(rows) for key, rows in groups.items()}


class Store(NamedTuple):
    """A pattern table small enough to be everywhere."""

    ids: np.ndarray
    vectors: np.ndarray | Arena
    keys: dict
    key_of: np.ndarray
    groups: dict
    meta: pa.Table

    def everywhere(self, qid: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int, exclude_self: bool) -> Found:
        row, col, far = nearest(qid[rows], q[rows], self.ids, self.vectors, k, exclude_self)
        return rows[row], col, far

    def within_key(self, qid: np.ndarray, q: np.ndarray, keys: list, k: int, exclude_self: bool) -> Found:
        """Small keys are compared together, large ones each on their own."""
        arena, parts, row_parts, col_parts, held = arena_of(self.vectors), [], [], [], 0
        for key, rows in rows_by_key(keys).items():
            mine = self.groups.get(key)
            if mine is None:
                continue
            if len(rows) * len(mine) > SMALL_PAIRS:
                ids, vectors = self.ids[mine], arena.take(mine)
                if len(mine) > 4 * LEAF_ROWS:
                    open_ = np.full(len(rows), np.inf)
                    row, col, far = nearest_in_leaves(qid[rows], q[rows], open_, ids, vectors, k, exclude_self)
                else:
                    row, col, far = nearest(qid[rows], q[rows], ids, vectors, k, exclude_self)
                parts.append((rows[row], mine[col], far))
                continue
            row_parts.append(np.repeat(rows, len(mine)))
            col_parts.append(np.tile(mine, len(rows)))
            held += len(rows) * len(mine)
            if held > DIRECT_PAIRS:
                parts.append(self._direct(qid, q, arena, row_parts, col_parts, k, exclude_self))
                row_parts, col_parts, held = [], [], 0
        if held:
            parts.append(self._direct(qid, q, arena, row_parts, col_parts, k, exclude_self))
        return joined(parts)

    def _direct(
        self, qid: np.ndarray, q: np.ndarray, arena: Arena, row_parts: list, col_parts: list, k: int, exclude_self: bool
    ) -> Found:
        if q.shape[1] != arena.size:
            raise ValueError(f"query size {q.shape[1]} differs from pattern size {arena.size}")
        row, col = np.concatenate(row_parts), np.concatenate(col_parts)
        if exclude_self:
            other = qid[row] != self.ids[col]
            row, col = row[other], col[other]
        far = _pair_distances(q, row, arena, col)
        keep = best_places(row, self.ids[col], far, k)
        return row[keep], col[keep], far[keep]

    def host_first(self, qid: np.ndarray, q: np.ndarray, keys: list, k: int, exclude_self: bool, post: bool) -> Found:
        """Own hits, then hits of other hosts where own ones are fewer than ``k // 2``."""
        # Hosts as numbers: no host is -1 for a query and -2 for a pattern.
        own = np.array([self.keys.get(key, -3) if key is not None else -1 for key in keys], "int64")
        if post:
            near = self.everywhere(qid, q, np.arange(len(qid)), k, exclude_self)
        else:
            near = self.within_key(qid, q, keys, k, exclude_self)
        owned = self.key_of[near[1]] == own[near[0]]
        first = tuple(part[owned] for part in near)
        counts = np.bincount(first[0], minlength=len(qid))
        lacking = np.flatnonzero((counts < k // 2) | (own == -1))
        if post:
            fill = tuple(part[~owned & np.isin(near[0], lacking)] for part in near)
        else:
            fill = self.everywhere(qid, q, lacking, k, exclude_self)
            other = self.key_of[fill[1]] != own[fill[0]]
            fill = tuple(part[other] for part in fill)
        row, col, far = joined([first, fill])
        general = np.repeat([0, 1], [len(first[0]), len(fill[0])])
        order = np.lexsort((self.ids[col], far, general, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left")
        keep = order[place < k]
        return row[keep], col[keep], far[keep]


def ranks(rows: np.ndarray) -> np.ndarray:
    """Rank within each run of equal row numbers, from 1."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
