"""Shingle sets and components against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from gaugewatch.llm import jaccard_join
from gaugewatch.llm.shingles import shingle_sets


def sets_of(text, words=5):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def groups(rows):
    """Each row's set and the number of its group, by all pairs."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def brute(rows):
    sets, group = groups(rows)
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(((d, len(s), least.get(g)) for (d, _), s, g in zip(rows, sets, group)), key=str)


def survivors(rows):
    """Ids that stay: the smallest of each group of rows, and of rows without words each text's."""
    sets, group = groups(rows)
    named = [(d, t, g, s) for (d, t), s, g in zip(rows, sets, group) if d is not None]
    some = {}
    for d, _, g, s in named:
        if s:
            some[g] = min(some.get(g, d), d)
    return sorted([*some.values(), *(d for d, _ in {(d, t) for d, t, _, s in named if not s})])


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(40)
    rows = [(i, " ".join(prose(rng.randint(1, 120)))) for i in range(80)]
    rows += [(100 + i, " ".join(prose(12) + passage + prose(rng.randint(0, 6)))) for i in range(30)]
    for g in range(8):
        base = prose(rng.choice([6, 30, 100, 200]))
        for i in range(rng.choice([2, 5, 25])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                near[rng.randrange(len(near))] = word()
            rows.append((1000 * (g + 1) + i, rng.choice(["  ", "\n"]).join(near).upper() if i % 3 else " ".join(near)))
    chain = prose(60)
    for i in range(12):  # each links with the next only
        chain = chain[1:] + [word()]
        rows.append((9000 - i, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, " ".join(passage)), (None, " ".join(passage)), (5, "one"), (6, "ONE"), (7, "one two")]
    rows += [(9900, "a b c d e " * 30), (9901, "a b c d e " * 50), (9902, "a b c d e")]
    rng.shuffle(rows)
    return rows


def test_set_sizes():
    texts = [t for _, t in corpus(1)]
    _, offsets = shingle_sets([(t or "").encode() for t in texts])
    assert [int(n) for n in offsets[1:] - offsets[:-1]] == [len(sets_of(t)) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(jaccard_join, "REGION", 4)
        monkeypatch.setattr(jaccard_join, "DENSE", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, sig int, block_ int")
    got = jaccard_join.components(docs.repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_representatives(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = jaccard_join.representatives(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == survivors(rows)
    assert ids.count(None) == 2


@pytest.mark.parametrize("dense", [1, 3, 32])
def test_intersections(dense, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = np.random.default_rng(dense)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    same = jaccard_join.intersections(sets)
    for i in range(30):
        for j in range(i):
            assert same[i, j] == same[j, i] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_empty_table(spark):
    assert jaccard_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_decide_not_ids(spark):
    """An id with two unlinked texts: the copy goes, the other text stays."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (5, one), (5, two), (5, two), (6, two), (7, ""), (7, None), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash_", F.lit(3))
    got = jaccard_join.representatives(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, one), (5, two), (7, ""), (7, None), (None, two)], key=str)
