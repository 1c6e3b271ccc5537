"""Codes of vectors: every step against plain loops, trees against all distances, awkward rows."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from gaugewatch.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, part int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in e], label) for i, e, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for k, members in groups.items():
                books[p][k] = [sum(v) // len(members) for v in zip(*members, strict=True)]
    out = []
    per_label = defaultdict(int)
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        per_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    text = ",".join(str(v) for book in books for c in book for v in c)
    return [(i, code, e, per_label[label], hashlib.sha256(text.encode()).hexdigest()) for i, code, e, label in out]


def key(row):
    return tuple((v is None, v) for v in row)


def sample(n, size, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    return [(int(i), (centres[i % 5] + spread * rng.normal(size=size)).tolist(), int(i % 3) if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("block", [64, 4096])
def test_brute_force(spark, block):
    rows = sample(400, 8)
    rows += [(3, rows[3][1], 3), (3, rows[4][1], 1), (None, rows[5][1], None), *[(1000 + i, rows[7][1], 1) for i in range(50)]]
    awkward = [(9, None, 1), (9, [], 1), (9, [None] * 8, 1), (9, [math.nan] * 8, 1), (9, [math.inf] * 8, 1), (9, [0.5] * 4, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + awkward], SCHEMA).repartition(5)
    books = vc.fit(df, "label", entries=16, block=block)
    got = vc.encode(books).collect()
    expected = brute(rows, entries=16)
    assert books.sha256() == expected[0][4]
    assert sorted(key((r.vec_id, r.code, r.error)) for r in got) == sorted(key(r[:3]) for r in expected)
    digest = vc.digest(df).collect()
    assert sorted(key(r) for r in digest) == sorted(key(r) for r in brute(rows))


def test_few_rows_ties_and_large_values(spark):
    rows = [(2, [1.0] * 8, 1), (1, [1.0] * 8, 1), (5, [-130000.7] * 8, 2), (6, [130000.7] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(key(r) for r in vc.digest(df).collect()) == sorted(key(r) for r in brute(rows))
    with pytest.raises(Exception, match="leave the range"):
        vc.digest(spark.createDataFrame([(1, [1e9] * 8, 1, "x", 1)], SCHEMA)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vc.digest(spark.createDataFrame([(1, [1.0] * 7, 1, "x", 1)], SCHEMA))


def test_empty_table(spark):
    out = vc.digest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not out.collect()


def test_decoded_vectors_are_near(spark):
    rows = sample(300, 8, spread=0.001)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    books = vc.fit(df, entries=16)
    back = {r.vec_id: r.embedding for r in vc.decode(vc.encode(books), books).collect()}
    assert all(np.abs(np.array(e) - back[i]).max() < 0.1 for i, e, _ in rows)


def tree_of(points):
    order, nodes = vc.cover_tree(points)
    return points[order], nodes


def test_cover_tree_holds_its_promises():
    rng = np.random.default_rng(1)
    points, nodes = tree_of(rng.integers(-500, 500, (2000, 3)))
    for n in nodes:
        own = points[n["begin"] : n["end"]]
        assert np.sqrt(((own - points[n["centre"]]) ** 2).sum(1)).max() <= n["radius"] * (1 + 1e-12)
        children = nodes[n["first"] : n["first"] + n["count"]]
        if len(children):
            assert children["begin"][0] == n["begin"] and children["end"][-1] == n["end"]
            assert (children["begin"][1:] == children["end"][:-1]).all() and children["centre"][0] == n["centre"]
            gaps = np.sqrt(vc.squares(points[children["centre"]], points[children["centre"]]))
            assert gaps[~np.eye(len(children), dtype=bool)].min() >= children["radius"].max() * (1 - 1e-9)


@pytest.mark.parametrize("spread", [0, 1, 30, 3000])
def test_subtrees_and_exact_points_agree_with_all_distances(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-2000, 2000, (12, 4))[rng.integers(0, 12, 1500)] + rng.integers(-spread, spread + 1, (1500, 4))
    entries = np.r_[points[:40], points[:3], rng.integers(-2000, 2000, (10, 4))]
    points, nodes = tree_of(points)
    expected = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (vc.assignment(points, nodes, entries) == expected).all()
    count, total = vc.totals(points, nodes, entries)
    assert (count == np.bincount(expected, minlength=len(entries))).all()
    for k in range(len(entries)):
        assert (total[k] == points[expected == k].sum(0)).all()
    begin, end, _, point, _ = vc.settle(points, nodes, entries)
    assert (end - begin).sum() + len(point) == len(points)


def test_tight_clusters_go_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (12, 4))
    points, nodes = tree_of(centres[rng.integers(0, 12, 1500)] + rng.integers(-30, 31, (1500, 4)))
    begin, _, _, point, _ = vc.settle(points, nodes, centres)
    assert not len(point) and len(begin) < 60
