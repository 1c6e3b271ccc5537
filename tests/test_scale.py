"""The helpers for skewed data give the plain results on both sides of their bounds."""

import pickle
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewatch.functions import vectors as kernel
from gaugewatch.operators import ivfpq, retrieval, scale


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 30,000 rows under one key, the rest over 200 keys and NULL."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 50 == 1, None).otherwise(F.concat(F.lit("k"), (n % 200).cast("string")))
    return spark.range(30_000).select(
        n.alias("row_id"), key.alias("key"), F.pmod(F.xxhash64(n), F.lit(5_000)).alias("value")
    )


def test_rank_in_groups_over_ranges(skewed):
    plain = scale.rank_in_groups(skewed, ["key"], ["value", "row_id"]).toPandas()
    cut = scale.rank_in_groups(skewed, ["key"], ["value", "row_id"], rows_per_range=1_500).toPandas()
    order = ["row_id"]
    cols = ["row_id", "position", "group_size"]
    left = plain.sort_values(order)[cols].reset_index(drop=True)
    right = cut.sort_values(order)[cols].reset_index(drop=True)
    pd.testing.assert_frame_equal(left, right, check_dtype=False)
    hot = plain[plain.key == "hot"].sort_values(["value", "row_id"])
    assert hot.position.tolist() == list(range(10_000))


def test_rank_over_everything(skewed):
    ranked = scale.rank_in_groups(skewed, [], ["value", "row_id"], rows_per_range=2_000).toPandas()
    ranked = ranked.sort_values(["value", "row_id"])
    assert ranked.position.tolist() == list(range(30_000))


def test_rank_by_a_text_key(skewed):
    """Positions do not depend on how many ranges there are, also with a text first or one repeated value."""
    few = skewed.filter("row_id % 100 = 0").withColumn("name", F.concat(F.lit("n"), F.col("row_id")))
    few = few.withColumn("same", F.lit("x"))
    for order in (["name"], ["same", "name"]):
        whole = scale.rank_in_groups(few, ["key"], order).select("row_id", "position", "group_size")
        cut_up = scale.rank_in_groups(few, ["key"], order, rows_per_range=3).select("row_id", "position", "group_size")
        assert sorted(whole.collect()) == sorted(cut_up.collect())
    tied = scale.rank_in_groups(few, [], ["same"], rows_per_range=7)
    assert sorted(r.position for r in tied.collect()) == list(range(few.count()))
    largest = tied.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < few.count()


def test_many_hot_keys_are_all_split(spark):
    facts = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.col("id") % 4_000).alias("key"), F.col("id").alias("row_id")
    )
    dim = spark.range(4_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("extra"))
    hot = scale._hot_keys(facts, ["key"], 10)
    assert hot.count() == 2_000 and hot.agg(F.min("_parts"), F.max("_parts")).first() == (2, 2)
    joined = scale.dimension_join(facts, dim, ["key"], max_rows=10, hot_rows=10)
    assert joined.count() == 60_000 and joined.filter("extra = 2 * key").count() == 30_000
    assert scale.dimension_join(facts, dim, ["key"], "inner", max_rows=10, hot_rows=10).count() == 30_000


@pytest.mark.parametrize("hot_rows", [1_000, 1_000_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_dimension_join_beyond_the_broadcast_bound(spark, skewed, how, hot_rows):
    keys = ["hot"] + [f"k{i}" for i in range(0, 200, 2)] + ["k0"]
    dim = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, extra int")
    small = scale.dimension_join(skewed, dim, ["key"], how)
    large = scale.dimension_join(skewed, dim, ["key"], how, max_rows=10, hot_rows=hot_rows)
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    assert ("_part" in large._jdf.queryExecution().optimizedPlan().toString()) or hot_rows > 10_000
    a = small.select("row_id", "key", "value", "extra").toPandas().sort_values(["row_id", "extra"])
    b = large.select("row_id", "key", "value", "extra").toPandas().sort_values(["row_id", "extra"])
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


@pytest.mark.parametrize("n", [7, 2_500])
def test_first_n_of_a_hot_group(skewed, n):
    got = scale.first_n(skewed, ["key"], ["value", "row_id"], n, spread=["row_id"]).toPandas()
    want = skewed.toPandas().sort_values(["value", "row_id"]).groupby("key", dropna=False).head(n)
    assert sorted(got.row_id) == sorted(want.row_id)
    assert got["rank"].max() == n


def test_hot_keys_are_found_and_split(skewed):
    hot = {r.key: r._parts for r in scale._hot_keys(skewed, ["key"], 1_000).collect()}
    assert hot == {"hot": 10}


def test_group_limit_runs_before_the_shuffle(skewed):
    plan = scale.first_n(skewed, ["key"], ["value", "row_id"], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _brute(q, p, k, by=None, exclude_self=False):
    rows = []
    for _, a in q.iterrows():
        mine = p[p[by] == a[by]] if by else p
        if exclude_self:
            mine = mine[mine.pattern_id != a.query_id]
        far = [(float(((np.array(a.embedding) - np.array(v)) ** 2).sum()), i) for v, i in zip(mine.embedding, mine.pattern_id)]
        rows += [(a.query_id, rank + 1, i, round(d, 6)) for rank, (d, i) in enumerate(sorted(far)[:k])]
    return sorted(rows)


@pytest.fixture(scope="module")
def vectors(spark):
    """600 patterns with many exact copies, a third of them of one host; 150 queries."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 4, (40, 6)).astype(float)

    def rows(n, shift):
        out = []
        for i in range(n):
            host = "hot" if i % 3 == 0 else None if i % 41 == 0 else f"h{i % 60}"
            out.append((i, [float(x) + shift for x in base[rng.integers(0, 40)]], host, "a", "", bool(i % 7 == 0)))
        return out

    schema = "{} bigint, embedding array<double>, host_id string, activity string, ts string, is_anomaly boolean"
    p = spark.createDataFrame(rows(600, 0.0), schema.format("pattern_id"))
    q = spark.createDataFrame(rows(150, 0.25), schema.format("query_id")).drop("is_anomaly")
    return q, p


STORES = {"shared": {}, "blocks": {"max_broadcast_bytes": 0, "rows_per_block": 70}}


@pytest.mark.parametrize("store", list(STORES))
@pytest.mark.parametrize("by", [None, "host_id"])
def test_knn_equals_brute_force(vectors, store, by):
    q, p = vectors
    got = retrieval.knn(q, p, 4, by=by, exclude_self=True, **STORES[store]).toPandas()
    got = sorted((r.query_id, r["rank"], r.pattern_id, round(r.distance, 6)) for _, r in got.iterrows())
    want = _brute(q.toPandas(), p.toPandas(), 4, by, True)
    assert got == want


@pytest.mark.parametrize("mode", ["pre", "post"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_both_stores_retrieve_the_same(vectors, mode, exclude_self):
    q, p = vectors
    found = [
        retrieval.retrieve_rows(q, p, 5, mode=mode, exclude_self=exclude_self, **options).toPandas()
        .sort_values(["query_id", "rank"]).reset_index(drop=True)
        for options in STORES.values()
    ]
    pd.testing.assert_frame_equal(found[0].drop(columns="readings"), found[1].drop(columns="readings"))
    assert found[0].groupby("query_id").size().max() == 5


def test_small_store_needs_no_shuffle(vectors):
    q, p = vectors
    plan = retrieval.retrieve(q, p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_large_store_has_no_cross_join(vectors):
    q, p = vectors
    plan = retrieval.retrieve(q, p, max_broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_queries_without_vectors_keep_their_row(spark, vectors):
    q, p = vectors
    odd = q.withColumn("embedding", F.when(F.col("query_id") % 2 == 0, F.col("embedding")))
    sizes = dict(retrieval.retrieve(odd, p).select("query_id", F.size("hits")).collect())
    assert len(sizes) == 150 and sizes[1] == 0 and sizes[0] == 5


def test_other_sizes_are_left_out(vectors):
    q, p = vectors
    short = q.withColumn("embedding", F.when(F.col("query_id") == 3, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    for options in ({}, {"max_broadcast_bytes": 0, "rows_per_block": 40}):
        found = {r.query_id for r in retrieval.knn(short, p, **options).collect()}
        assert 3 not in found and len(found) == 149
    counts = dict(map(tuple, retrieval.unusable_counts(short, retrieval.store_dim(p)).collect()))
    assert counts == {"usable": 149, "other size": 1}


def test_ivfpq_with_a_hot_cell(spark, vectors):
    """All vectors probed in all cells with fine codes: near to exact search."""
    q, p = vectors
    index = ivfpq.ivfpq_create(p, ivfpq.ivfpq_train(p, nlist=4, m=3, bits=6))
    got = ivfpq.ivfpq_search(q, index, 5, nprobe=4, rows_per_block=50)
    exact = retrieval.knn(q, p, 5)
    assert got.count() == exact.count() == 750
    limit = exact.groupBy("query_id").agg(F.max("distance").alias("worst"))
    close = got.join(limit, "query_id").filter(F.col("distance") <= F.col("worst") + 0.5).count()
    assert close / 750 > 0.9


def test_small_keys_meet_in_few_groups(spark, monkeypatch):
    """One group per host would be 1,500 of them."""
    rng = np.random.default_rng(8)
    v = rng.integers(0, 9, (3000, 4)).astype(float)
    rows = [(i, x.tolist(), "hot" if i % 5 == 0 else None if i % 97 == 0 else f"h{i // 2}") for i, x in enumerate(v)]
    p = spark.createDataFrame(rows, "pattern_id long, embedding array<double>, host_id string")
    q = p.withColumnRenamed("pattern_id", "query_id")
    groups, pair_blocks = [], retrieval.pair_blocks

    def counted(left, right, by, *args, **options):
        groups.append(left.select(*by).distinct().count())
        return pair_blocks(left, right, by, *args, **options)

    monkeypatch.setattr(retrieval, "pair_blocks", counted)
    hits = retrieval.knn(q, p, 3, by="host_id", exclude_self=True, max_broadcast_bytes=0, rows_per_block=400).toPandas()
    got = sorted((r.query_id, r.rank, r.pattern_id, round(r.distance, 6)) for r in hits.itertuples())
    frame = pd.DataFrame(rows, columns=["pattern_id", "embedding", "host_id"])
    known = frame[frame.host_id.notna()]
    some = known[known.pattern_id < 200].rename(columns={"pattern_id": "query_id"})
    assert [x for x in got if x[0] < 200] == _brute(some, known, 3, "host_id", True)
    assert max(groups) <= 20


def _plain_nearest(qid, q, ids, v, k):
    """(query place, pattern place, distance) of the ``k`` nearest other patterns, by plain sums."""
    out = set()
    for i in range(len(q)):
        far = np.zeros(len(v))
        for d in range(v.shape[1]):
            far += (q[i, d] - v[:, d]) * (q[i, d] - v[:, d])
        order = [j for j in np.lexsort((ids, far)) if ids[j] != qid[i]][:k]
        out |= {(i, int(j), float(far[j])) for j in order}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e12])
def test_products_in_single_precision_only_narrow_down(scale):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16)) * scale
    v[700:1400] = v[:700] * (1 + 1e-9)  # nearly equal: far below what single precision tells apart
    v[1400:] = v[:100]
    ids, qid, q = rng.permutation(1500), np.arange(300), v[:300] * (1 + 1e-8)
    want = _plain_nearest(qid, q, ids, v, 4)
    for found in (
        kernel.nearest(qid, q, ids, v, 4, True),
        kernel.nearest_in_leaves(qid, q, np.full(300, np.inf), ids, v, 4, True),
    ):
        assert set(zip(*[part.tolist() for part in found])) == want


def _held_by(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_a_search_holds_tiles_of_products_whatever_the_store():
    rng = np.random.default_rng(6)
    ids, v = np.arange(40_000), rng.normal(size=(40_000, 16))
    store = kernel.Store(ids, v, {}, np.empty(0, "int64"), {}, None)
    held = _held_by(lambda: store.everywhere(ids[:600], v[:600], np.arange(600), 5, True))
    assert held < 3 * v.nbytes + (16 << 20)


def test_a_search_measures_few_pairs_exactly(monkeypatch):
    rng = np.random.default_rng(7)
    ids, v = np.arange(20_000), rng.normal(size=(20_000, 64))
    pairs, plain = [], kernel.squared_rows
    monkeypatch.setattr(kernel, "squared_rows", lambda a, b: pairs.append(len(a)) or plain(a, b))
    row, _, _ = kernel.nearest_in_leaves(ids[:500], v[:500], np.full(500, np.inf), ids, v, 5, True)
    assert len(row) == 2500 and sum(pairs) < 200 * 500


def test_a_meeting_of_codes_holds_few_distances():
    # Several arrays of this many distances are held at once, by every worker.
    assert 8 * ivfpq.HELD_CELLS <= 2 << 20


def test_a_store_of_single_precision_is_held_once_in_single_precision():
    rng = np.random.default_rng(8)
    ids, v = np.arange(40_000), rng.normal(size=(40_000, 64)).astype(np.float32).astype(np.float64)
    store = kernel.Store(ids, kernel.arena_of(v), {}, np.empty(0, "int64"), {}, None)
    assert len(pickle.dumps(store)) < 0.6 * v.nbytes
    found = []
    # A batch of queries adds no copy of the store.
    assert _held_by(lambda: found.append(store.everywhere(ids[:300], v[:300], np.arange(300), 5, True))) < 8 << 20
    assert set(zip(*[part.tolist() for part in found[0]])) == _plain_nearest(ids[:300], v[:300], ids, v, 5)


def test_values_beyond_single_precision_stay_as_they_are():
    v = np.array([[0.1, 0.2], [0.1, 0.2 + 1e-12], [3.0, 4.0]])
    assert (kernel.arena_of(v).take(np.array([1, 2])) == v[1:]).all()


def test_ties_of_a_common_vector_are_measured_in_tiles():
    ids, v = np.arange(20_000), np.ones((20_000, 64))
    found = []
    assert _held_by(lambda: found.append(kernel.nearest(ids[:20], v[:20], ids, v, 5, True))) < 3 * v.nbytes + (32 << 20)
    assert found[0][1][:10].tolist() == [1, 2, 3, 4, 5, 0, 2, 3, 4, 5]


def test_single_precision_counts_half_towards_the_broadcast(spark):
    rows = spark.range(100).select(
        F.col("id").alias("pattern_id"), F.array(*[F.col("id") + i for i in range(16)]).cast("array<float>").alias("embedding")
    )
    whole = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert retrieval._shared_store(rows, None, False, 100 * 16 * 4) is not None
    assert retrieval._shared_store(whole, None, False, 100 * 16 * 4) is None


def test_codes_are_searched_by_products_and_few_pairs_are_measured(monkeypatch):
    rng = np.random.default_rng(9)
    centres, books = rng.normal(size=(3, 16)), rng.normal(size=(4, 8, 4))
    cell, codes, ids = np.sort(rng.integers(0, 3, 4000)), rng.integers(0, 8, (4000, 4)).astype(np.uint8), rng.permutation(4000)
    store = kernel.Codes(ids, codes, np.searchsorted(cell, np.arange(4)))
    q, probed, first = rng.normal(size=(300, 16)), rng.random((300, 3)) < 0.7, rng.integers(0, 3, 300)
    probed[np.arange(300), first] = True
    pairs, plain = [], kernel.squared_rows
    monkeypatch.setattr(kernel, "squared_rows", lambda a, b: pairs.append(len(a)) or plain(a, b))
    row, col, far = kernel.nearest_codes(ids[:300], q, probed, first, store, centres, books, 6, True, 50, 1)
    assert sum(pairs) < 300 * 600
    made = np.concatenate([book[code] for book, code in zip(books, codes.T)], axis=1)
    want = set()
    for i in range(300):
        rest = q[i] - centres[cell]
        apart = plain(rest, made)
        apart[~probed[i, cell] | (ids == ids[i])] = np.inf
        want |= {(i, int(j), round(float(apart[j]), 9)) for j in np.lexsort((ids, apart))[:6]}
    assert set(zip(row.tolist(), col.tolist(), np.round(far, 9).tolist())) == want


def test_candidates_meet_vectors_in_blocks(spark, vectors, monkeypatch):
    """Broadcast or in blocks, the same hits; a query travels once to a block, whatever the number of its candidates."""
    q, p = vectors
    index = ivfpq.ivfpq_create(p, ivfpq.ivfpq_train(p, nlist=4, m=3, bits=3, rounds=2))

    def found(**options):
        hits = ivfpq.ivfpq_search(q, index, 4, nprobe=2, exclude_self=True, **options)
        return sorted((r.query_id, r.rank, r.pattern_id, round(r.distance, 9)) for r in hits.collect())

    plain, refined = found(), found(refine=5, patterns=p)
    dim = len(p.first().embedding)
    monkeypatch.setattr(ivfpq, "BLOCK_BYTES", 8 * dim * 90)
    assert found(refine=5, patterns=p) == refined
    monkeypatch.setattr(ivfpq, "BROADCAST_CODE_BYTES", 0)
    assert found() == plain and found(refine=5, patterns=p) == refined


@pytest.mark.parametrize("most", [1, 300, 1 << 40])
def test_best_places_are_those_of_a_full_sort(most):
    rng = np.random.default_rng(10)
    rows, far, ids = rng.integers(-2, most, 5000), rng.integers(0, 50, 5000) / 7.0, rng.permutation(5000)
    order = np.lexsort((ids, far, rows))
    turn = np.arange(5000) - np.searchsorted(rows[order], rows[order], side="left")
    assert kernel.best_places(rows, ids, far, 4).tolist() == order[turn < 4].tolist()
    assert not len(kernel.best_places(rows[:0], ids[:0], far[:0], 4))
