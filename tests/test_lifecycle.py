"""Indexes, weights and stores that change with time: rounds, versions, reruns after failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewatch.functions.vectors import nearest
from gaugewatch.operators import answers, cells, contrastive, embedder, ivfpq, profile_states, profiling, retrieval, sampling
from gaugewatch.sources import pattern_store


def table(spark, vectors, name="pattern_id", **more):
    rows = [(i, [float(x) for x in v], f"h{i % 3}", i % 5 == 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>, host_id string, is_anomaly boolean")


def clusters(n, size=6, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(8, size))[rng.integers(0, 8, n)] * 5 + spread * rng.normal(size=(n, size))


def found(hits):
    return {(r.query_id, r.rank): (r.pattern_id, round(r.distance, 9)) for r in hits.collect()}


def exact(queries, patterns, k, exclude_self=False):
    ids = np.arange(len(patterns))
    row, col, far = nearest(np.arange(len(queries)), queries, ids, patterns, k, exclude_self)
    out, seen = {}, {}
    for q, p, d in sorted(zip(row.tolist(), col.tolist(), far.tolist()), key=lambda x: (x[0], x[2], x[1])):
        seen[q] = seen.get(q, 0) + 1
        out[q, seen[q]] = (p, round(d, 9))
    return out


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_cells_are_exact_and_prune(spark, spread):
    patterns, queries = clusters(600, spread=spread), clusters(80, seed=1, spread=spread)
    patterns[5:40] = patterns[5]  # ties
    index = cells.build_cells(table(spark, patterns), rows_per_cell=30)
    got = cells.search_cells(table(spark, queries, "query_id"), index, 7, rows_per_block=25)
    assert found(got.hits) == exact(queries, patterns, 7)
    report = {r["round"]: r for r in got.report.collect()}
    compared = sum(r.compared for r in report.values())
    assert report[1].possible == 80 * 600 and report[1].queries == report[1].cells == 80
    if spread < 1:
        assert compared < 80 * 600 / 3


def test_queries_travel_to_areas_however_many_cells_there_are(spark, monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(400, 24))  # far apart: the bounds rule out hardly a cell
    index = cells.build_cells(table(spark, vectors), rows_per_cell=4)
    assert index.bounds.count() > 80
    moved, pair_blocks = [], cells.pair_blocks

    def counted(left, *args, **options):
        moved.append(left.count())
        return pair_blocks(left, *args, **options)

    monkeypatch.setattr(cells, "pair_blocks", counted)
    monkeypatch.setattr(cells, "AREA_ROWS", 10, raising=False)
    got = cells.search_cells(table(spark, vectors, "query_id"), index, 3, exclude_self=True)
    assert found(got.hits) == exact(vectors, vectors, 3, True)
    assert max(moved) <= 20 * len(vectors)


def test_cells_in_blocks_on_both_sides(spark, monkeypatch):
    """An area beyond a task's bound is cut; whole groups of copies keep their ties by id."""
    vectors = np.random.default_rng(4).integers(0, 3, (300, 4)).astype(float)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 8 * 4 * 60, raising=False)
    index = cells.build_cells(table(spark, vectors), rows_per_cell=7)
    got = cells.search_cells(table(spark, vectors, "query_id"), index, 6, exclude_self=True, rows_per_block=5)
    assert found(got.hits) == exact(vectors, vectors, 6, True)


def test_cells_grow_and_ignore_unfinished_batches(spark):
    patterns = clusters(300)
    known = table(spark, patterns)
    index = cells.build_cells(known.filter("pattern_id < 200"), rows_per_cell=30, carry=["host_id"])
    far_away = known.filter("pattern_id >= 200").withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    cells.add_to_cells(index, far_away)
    # A batch whose extents were never written.
    known.withColumns({"cell": F.lit(0), "distance": F.lit(0.0)}).write.parquet(f"{index.path}/rows/died")
    index = cells.load_cells(spark, index.path)
    assert index.rows.count() == 300 and "host_id" in index.rows.columns
    moved = np.concatenate([patterns[:200], patterns[200:] * 3])
    got = cells.search_cells(table(spark, moved, "query_id"), index, 4, exclude_self=True)
    assert found(got.hits) == exact(moved, moved, 4, True)


def test_cells_with_odd_vectors(spark):
    rows = [(i, v, "h", False) for i, v in enumerate([[1.0, 2.0], None, [float("nan"), 1.0], [1.0], [3.0, 4.0], [1.0, 2.0]])]
    df = spark.createDataFrame(rows, "pattern_id long, embedding array<double>, host_id string, is_anomaly boolean")
    index = cells.build_cells(df, rows_per_cell=1)
    got = cells.search_cells(df.withColumnRenamed("pattern_id", "query_id"), index, 2).hits.collect()
    assert {(r.query_id, r.pattern_id) for r in got} == {(0, 0), (0, 5), (4, 4), (4, 0), (5, 0), (5, 5)}
    assert not cells.search_cells(df.limit(0).withColumnRenamed("pattern_id", "query_id"), index, 2).hits.collect()
    with pytest.raises(ValueError, match="usable"):
        cells.build_cells(df.filter("pattern_id = 1"))


def test_retrieval_by_cells_is_retrieval(spark):
    patterns = clusters(200, spread=1.0)
    p, q = table(spark, patterns), table(spark, patterns[:50] + 0.1, "query_id")
    small = retrieval.retrieve_rows(q, p, 5)
    large = retrieval.retrieve_rows(q, p, 5, max_broadcast_bytes=0, rows_per_block=20)
    assert found(small) == found(large)


def test_ivfpq_added_is_as_made_at_once_and_refuses_other_models(spark):
    p = table(spark, clusters(300, size=8, spread=1.0))
    model = ivfpq.ivfpq_train(p, nlist=4, m=4, bits=4, rounds=3)
    whole = ivfpq.ivfpq_create(p, model, carry=["host_id"])
    part = ivfpq.ivfpq_create(p.filter("pattern_id < 100"), model, carry=["host_id"])
    part = ivfpq.ivfpq_add(part, p.filter("pattern_id >= 100"))
    # A batch that is not in the ledger.
    whole.codes.write.parquet(f"{part.path}/codes/died")
    part = ivfpq.ivfpq_load(spark, part.path, model.version)
    assert sorted(map(tuple, whole.codes.collect())) == sorted(map(tuple, part.codes.collect()))
    q = p.withColumnRenamed("pattern_id", "query_id")
    assert found(ivfpq.ivfpq_search(q, whole, 5, 2, by="host_id")) == found(ivfpq.ivfpq_search(q, part, 5, 2, by="host_id"))
    with pytest.raises(ValueError, match="has model"):
        ivfpq.ivfpq_load(spark, part.path, "another")
    other = ivfpq.ivfpq_model(model.centres + 1, model.codebooks)
    ivfpq._append(p, part.path, other, ["host_id"])
    with pytest.raises(ValueError, match="another model"):
        ivfpq.ivfpq_load(spark, part.path)


def test_ivfpq_probes_until_k_hits_can_exist(spark):
    p = table(spark, clusters(300, size=8, spread=0.5))
    rare = p.withColumn("host_id", F.when(F.col("pattern_id") % 60 == 0, "rare").otherwise("usual"))
    index = ivfpq.ivfpq_create(rare, ivfpq.ivfpq_train(p, nlist=8, m=4, bits=3, rounds=3), carry=["host_id", "is_anomaly"])
    q = rare.withColumnRenamed("pattern_id", "query_id")
    hits = ivfpq.ivfpq_search(q, index, 5, nprobe=1, by="host_id")
    assert hits.groupBy("query_id").count().filter("count <> 5").count() == 0 and hits.count() == 1500
    flagged = ivfpq.ivfpq_search(q, index, 5, nprobe=1, where="is_anomaly")
    assert flagged.filter("pattern_id % 5 <> 0").count() == 0 and flagged.count() == 1500


def test_ivfpq_recall_with_exact_ranks(spark):
    patterns = clusters(500, size=16, spread=1.0)
    p, q = table(spark, patterns), table(spark, clusters(60, size=16, seed=3, spread=1.0), "query_id")
    index = ivfpq.ivfpq_create(p, ivfpq.ivfpq_train(p, nlist=8, m=8, bits=5, rounds=4))
    told = ivfpq.ivfpq_recall(ivfpq.ivfpq_search(q, index, 5, 6, refine=8, patterns=p), retrieval.knn(q, p, 5)).first()
    assert told["hits"] == 300 and told["recall"] >= 0.9
    with pytest.raises(ValueError, match="vectors"):
        ivfpq.ivfpq_search(q, index, 5, 6, refine=8)


def test_trained_vectors_in_store_and_detection(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) + 4 * (i % 2)], i % 2, i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, kind int, place int")
    made = embedder.fit_embedder(df, ["kind", "place"], dim=4, hidden=(8, 8), epochs=3, label_weights=[1.0, 0.2])
    embedder.save_embedder(spark, made, str(tmp_path / "w"))
    embedder.save_embedder(spark, made, str(tmp_path / "w"))  # again: nothing is added
    loaded = embedder.load_embedder(spark, str(tmp_path / "w"), made.version)
    assert all((a == b).all() for a, b in zip(made.weights, loaded.weights))
    samples = df.select(
        F.col("row_id").alias("query_id"), F.concat(F.lit("h"), "place").alias("host_id"), F.lit("walk").alias("activity"),
        F.lit("").alias("ts"), F.create_map(F.lit("x"), F.lit(1.0)).alias("readings"), "features", "kind",
    )
    known = embedder.embed_rows(samples.filter("query_id < 80"), loaded).withColumnsRenamed({"query_id": "pattern_id"})
    known = known.withColumns({
        "is_anomaly": F.col("kind") == 1, "anomaly_type": F.lit("technical"), "description": F.lit(""), "explanation": F.lit("seen"),
    })
    store = str(tmp_path / "s")
    pattern_store.append_to_store(known, store)
    got = embedder.detect_embedded(samples.filter("query_id >= 80"), pattern_store.read_store(spark, store), loaded, threshold=50.0)
    told = {r.query_id: r.is_anomaly for r in got.collect()}
    assert len(told) == 40 and np.mean([told[i] == (i % 2 == 1) for i in told]) > 0.9
    plain = contrastive.embed(samples, loaded.weights).filter("query_id = 90").first()["embedding"]
    assert plain == embedder.embed_rows(samples, loaded).filter("query_id = 90").first()["embedding"]

    other = embedder.embedder_of(made.weights._replace(b3=made.weights.b3 + 1))
    with pytest.raises(embedder.VersionMismatch):
        embedder.detect_embedded(samples, pattern_store.read_store(spark, store), other)
    with pytest.raises(embedder.VersionMismatch):
        embedder.detect_embedded(samples, known.drop("embedding_version"), loaded)
    with pytest.raises(embedder.VersionMismatch):
        pattern_store.apply_feedback(spark, store, feedback(spark, 1), other)


def feedback(spark, n):
    sample = F.struct(
        F.lit("h").alias("host_id"), F.lit("walk").alias("activity"), F.lit("").alias("ts"),
        F.create_map(F.lit("x"), F.lit(1.0)).alias("readings"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"),
    )
    review = F.struct(F.lit(True).alias("correct"), (F.col("id") % 2 == 0).alias("actual_anomaly"),
                      F.lit("technical").alias("anomaly_type"), F.lit(None).cast("string").alias("notes"))
    return spark.range(n).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("feedback_id"), F.lit("2024").alias("timestamp"),
        F.when(F.col("id") != 3, sample).alias("sample"),
        F.struct(F.lit(True).alias("is_anomaly"), F.lit(0.5).alias("confidence")).alias("detection"),
        review.alias("user_feedback"), F.lit(False).alias("processed"),
    )


def test_feedback_is_applied_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    log = feedback(spark, 6)
    # The job dies between its writes.
    with monkeypatch.context() as patch:
        def dies(*_):
            raise RuntimeError("lost")

        patch.setattr(pattern_store, "finish_batch", dies)
        with pytest.raises(RuntimeError, match="lost"):
            pattern_store.apply_feedback(spark, path, log)
    assert pattern_store.read_store(spark, path).count() == 0 and pattern_store.read_used(spark, path).count() == 0
    first = pattern_store.apply_feedback(spark, path, log).first()
    assert (first["total"], first["processed"], first["failed"]) == (6, 5, 1)
    again = pattern_store.apply_feedback(spark, path, log).first()
    assert (again["total"], again["processed"], again["failed"]) == (1, 0, 1)
    pattern_store.apply_feedback(spark, path, feedback(spark, 8))
    rows = pattern_store.read_store(spark, path).orderBy("pattern_id").collect()
    assert [r.pattern_id for r in rows] == list(range(7))
    assert [r.embedding[1] for r in rows] == [0.0, 1.0, 2.0, 4.0, 5.0, 6.0, 7.0]
    assert [r.is_anomaly for r in rows] == [True, False, True, True, False, True, False]


def test_profiles_merge_to_the_profile_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = [None if i % 11 == 0 else "n/a" if i % 97 == 0 else f"{1e6 + rng.normal():.6f}" for i in range(600)]
    rows = [(i, f"d{i % 7}", "s" if i % 3 else None, f"k{i % 5}", "p", v, None if i % 2 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ingest_id long, day string, subsystem string, sensor string, parameter string, value_hrf string, value_raw string")
    path, day = str(tmp_path / "states"), F.col("day")
    for some in (["d0", "d1"], ["d2", "d3", "d4", "d5", "d6"], ["d3"], []):
        states = profile_states.sensor_states(df.filter(F.col("day").isin(some)), day)
        profile_states.save_states(states, path)
    merged = profile_states.merge_sensor_states(profile_states.load_states(spark, path, states.schema))
    key = lambda r: (r.subsystem or "", r.sensor)
    got, expected = (sorted(x.collect(), key=key) for x in (merged, profiling.sensor_profile(df)))
    assert len(got) == len(expected) == 10
    for a, b in zip(got, expected, strict=True):
        assert a.asDict().keys() == b.asDict().keys()
        for name, value in b.asDict().items():
            assert a[name] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), name
    keys = ["sensor", "parameter"]
    combos = profile_states.combo_states(df, day, keys)
    assert profile_states.merge_combo_states(combos, keys).first() == profiling.dataset_stats(df, keys).first()
    assert profile_states.merge_combo_states(combos.limit(0), keys).first()["total_samples"] == 0


def test_only_prompts_without_an_answer_are_asked_again(spark, tmp_path):
    prompts = spark.createDataFrame([(i, "contextual", f"prompt {i}") for i in range(20)] + [(3, "contextual", "zzz")], "query_id long, prompt_kind string, prompt string")
    path, seen = str(tmp_path / "ledger"), str(tmp_path / "seen")

    def generate(texts, odd_fails=True):
        with open(seen, "a") as file:
            file.writelines(t + "\n" for t in texts if len(texts) == 1 or not odd_fails)
        if odd_fails and any(int(t.split()[1]) % 2 for t in texts):
            raise TimeoutError("slow")
        return [t.upper() for t in texts]

    assert answers.ask_all(prompts, generate, path, attempts=2).count() == 10
    first = answers.read_attempts(spark, path)
    assert first.filter("answer is null").count() == 20 and first.count() == 30
    assert first.filter("error like 'TimeoutError%'").count() == 20
    got = answers.ask_all(prompts, lambda texts: [t.upper() for t in texts], path, attempts=3)
    told = {r.query_id: (r.answer, r.attempts) for r in got.collect()}
    assert told == {i: (f"PROMPT {i}", 3 if i % 2 else 1) for i in range(20)}
    assert answers.read_attempts(spark, path).count() == 40


@pytest.mark.parametrize("lanes", [256, 2])
def test_bottom_k_is_the_sample_per_node(spark, monkeypatch, lanes):
    monkeypatch.setattr(sampling, "STATE_ROWS", 30)
    rows = [(i, None if i % 10 == 9 else "hot" if i % 3 else f"n{i % 8}", "x" * (i % 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "ingest_id long, node_id string, note string").repartition(7)
    got = sampling.sample_bottom_k(df, 12, tasks_per_lane=lanes)
    assert sorted(map(str, got.collect())) == sorted(map(str, sampling.sample_per_node(df, 12).collect()))
    assert got.columns == df.columns and "Window" not in got._jdf.queryExecution().toString()
    assert sampling.sample_bottom_k(df.limit(0), 12).count() == 0


@pytest.mark.parametrize("copies", [1, 300])
def test_queries_travel_to_the_boxes_that_their_distances_reach(spark, monkeypatch, copies):
    """Cells of many rows: a query meets a few boxes of them, not all blocks of a hash."""
    vectors = np.random.default_rng(8).uniform(size=(3000, 3)).round(2)
    vectors[:copies] = vectors[0]  # a box of them cannot be cut
    monkeypatch.setattr(cells, "BLOCK_BYTES", 8 * 3 * 150)
    monkeypatch.setattr(cells, "PART_ROWS", 150, raising=False)
    index = cells.build_cells(table(spark, vectors), rows_per_cell=1500)
    moved, pair_blocks = [], cells.pair_blocks

    def counted(left, right, by, *args, blocks=None, **options):
        rights = {b[0]: b[2] for b in blocks}
        moved.extend(r["count"] * rights.get(r[by[0]], 1) for r in left.groupBy(*by).count().collect())
        return pair_blocks(left, right, by, *args, blocks=blocks, **options)

    monkeypatch.setattr(cells, "pair_blocks", counted)
    got = cells.search_cells(table(spark, vectors, "query_id"), index, 5, exclude_self=True)
    assert found(got.hits) == exact(vectors, vectors, 5, True)
    assert sum(moved) < 8 * len(vectors)
    report = {r["round"]: r for r in got.report.collect()}
    assert report[1].queries == report[1].cells == 3000 and report[1].possible == 3000 * 3000


def test_boxes_are_left_out_where_they_spare_nothing():
    rng = np.random.default_rng(12)
    for vectors, spares in ((rng.normal(size=(2000, 64)), False), (rng.uniform(size=(2000, 3)), True)):
        part = cells._tree(vectors, 30, 0).parts(vectors)
        assert len(np.unique(part)) == 30 and (cells._reached(vectors, part, 5) < 0.5) == spares
