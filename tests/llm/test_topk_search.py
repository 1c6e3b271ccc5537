"""Top-k against all inner products."""

import random

import numpy as np
import pytest

from gaugewatch.llm import topk_search


def brute(rows, k=20, every=20):
    valid = [
        (i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in e])
        for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = []
    for q in sorted({i for i, _ in valid if i % every == 0}):
        scored = sorted(
            (-sum(a * b for a, b in zip(e, v)), i) for j, e in valid if j == q for i, v in valid if i != q and len(v) == len(e)
        )
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def vectors(seed, n=400, size=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector many times: ties
    rows += [(2000, None), (2020, [float("nan")] * size), (2040, [1.0, None] * (size // 2)), (2060, [float("inf")] * size)]
    rows += [(None, rows[0][1]), (3000, [1.0] * 3), (3001, [2.0] * 3), (3020, [3.0] * 3), (4000, []), (4001, []), (5000, [5.0])]
    rows += [(6000, [0.0] * size), (20, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell_rows", [16, 10_000])
def test_against_all_products(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(topk_search, "PROBES", 4)
    rows = vectors(cell_rows)
    table = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, size int, cell int")
    got = topk_search.top_k(table.repartition(3), cell_rows=cell_rows, pivots=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (8, 16))
    v = (centres[np.arange(800) % 8] + rng.integers(-3, 4, (800, 16))).astype(np.int64)
    norm = (v.astype(float) ** 2).sum(1)
    pivots = topk_search.choose_pivots([(16, r.astype("<i8").tobytes(), n) for r, n in zip(v, norm)], norm.max(), 8)[16]
    to = topk_search._distances(topk_search._extended(v, norm, norm.max()), pivots)
    nearest, radius = to.argmin(1), to.min(1)
    query = topk_search._distances(np.c_[v[:20].astype(float), np.zeros(20)], pivots)
    bound = topk_search.upper_bounds(norm[:20], query[:, nearest], radius, radius, norm.max())
    score = v[:20] @ v.T
    assert (bound >= score).all()
    kth = np.sort(score, 1)[:, -20]
    assert (bound < kth[:, None]).mean() > 0.5


def test_what_leaves_64_bits_is_refused(spark):
    for value in (1e30, 1e9):
        rows = [(i, [value] * 4) for i in range(3)]
        with pytest.raises(Exception, match="64-bit"):
            topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()


def test_empty_table(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("cell_rows", [16, 10_000])
def test_every_vector_of_an_id(spark, cell_rows):
    """As in the SQL: no vector is lost to another row of its id, usable or not."""
    rng = random.Random(8)
    one = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, one()) for i in range(120)] + [(i, one()) for i in range(0, 60, 3)]
    rows += [(i, bad) for i in range(0, 120, 4) for bad in ([float("nan")] * 6, [float("inf")] * 6, [None] * 6, None)]
    valid = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in e]) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q in range(0, 120, 20):
        scored = sorted((-sum(a * b for a, b in zip(e, v)), i) for j, e in valid if j == q for i, v in valid if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:20], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk_search.top_k(table, cell_rows=cell_rows, pivots=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
