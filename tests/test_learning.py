"""The loss, its gradient and the training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewatch.functions import network as net
from gaugewatch.operators import contrastive as con
from gaugewatch.operators import features


def test_gradient_by_finite_differences():
    draw = np.random.default_rng(0)
    w = net.initial_weights(5, 4, (7, 6), 1)
    x, y = draw.normal(size=(9, 5)), draw.integers(0, 3, (9, 2))
    masks = tuple((draw.random((9, n)) >= 0.2) / 0.8 for n in (7, 6))

    def loss(values):
        return net.batch_gradient(net.unflat(values, w), x, y, [1.0, 2.0], 3.0, 0.5, masks)[0]

    theta = net.flat(w)
    gradient = net.flat(net.batch_gradient(w, x, y, [1.0, 2.0], 3.0, 0.5, masks)[1])
    for i in range(0, len(theta), 3):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert (loss(theta + step) - loss(theta - step)) / 2e-6 == pytest.approx(gradient[i], abs=1e-6)


@pytest.fixture(scope="module")
def rows(spark):
    """Three clouds of points; the label names the cloud."""
    n = F.col("id")
    shift = (n % 3) * 4.0
    return spark.range(192).select(
        n.alias("row_id"), (n % 3).alias("label"),
        F.array(*[F.sin(n * (i + 1.0)) + shift * (1.0 if i < 2 else -0.5) for i in range(4)]).alias("features"),
    )


def test_loss_in_tiles(rows):
    batched = features.assign_batches(rows, 96).withColumnRenamed("features", "embedding")
    whole = con.contrastive_loss(batched, ["label"], margin=5.0).orderBy("batch_id").collect()
    tiled = con.contrastive_loss(batched, ["label"], margin=5.0, tile_rows=10).orderBy("batch_id").collect()
    assert [r.batch_id for r in whole] == [0, 1]
    for a, b in zip(whole, tiled):
        assert a.loss == pytest.approx(b.loss) and a.pos_weight == b.pos_weight


def test_loss_equals_the_batch_loss(rows):
    """The table form and the network's own form agree."""
    batched = features.assign_batches(rows, 64).withColumnRenamed("features", "embedding")
    got = {r.batch_id: r.loss for r in con.contrastive_loss(batched, ["label"], margin=9.0, lambda_neg=0.3).collect()}
    for batch_id, part in batched.toPandas().groupby("batch_id"):
        e, y = np.array(part.embedding.tolist()), part.label.to_numpy()
        far = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
        same = (y[:, None] == y[None]) & ~np.eye(len(y), dtype=bool)
        other = y[:, None] != y[None]
        want = far[same].sum() / (same.sum() + 1e-8) + 0.3 * np.maximum(9.0 - far, 0)[other].sum() / (other.sum() + 1e-8)
        assert got[batch_id] == pytest.approx(want)


def test_training_separates_the_clouds(rows):
    options = dict(dim=8, hidden=(16, 8), epochs=6, lr=2e-2, margin=4.0, dropout=0.1)
    trained = con.fit_contrastive(rows, ["label"], **options)
    assert trained.losses[-1] < 0.6 * trained.losses[0]
    again = con.fit_contrastive(rows, ["label"], **options)
    np.testing.assert_allclose(net.flat(trained.weights), net.flat(again.weights), rtol=1e-6)
    out = con.embed(rows, trained.weights, 12).toPandas()
    assert len(out) == 192 and out.embedding.map(len).eq(12).all() and out.embedding.map(lambda v: v[-1]).eq(0).all()


def test_batches_are_equal(rows):
    sizes = features.assign_batches(rows, 60).groupBy("batch_id").count().collect()
    assert {r["count"] for r in sizes} == {64} and len(sizes) == 3


@pytest.mark.parametrize("count", [2, 251, 1009])
def test_every_number_of_rows_trains(spark, count):
    n = F.col("id")
    rows = spark.range(count).select(
        n.alias("row_id"), (n % 2).alias("label"), (n % 3).alias("kind"),
        F.array(*[F.sin(n * (i + 1.0)) + (n % 2) * 3.0 for i in range(4)]).alias("features"),
    )
    batches = features.near_equal_batches(rows, 64).groupBy("batch_id").count().collect()
    sizes = [r["count"] for r in batches]
    assert sum(sizes) == count and max(sizes) - min(sizes) <= 1 and (count < 64 or min(sizes) > 40)
    losses = con.fit_contrastive(rows, ["label", "kind"], dim=6, hidden=(16, 8), epochs=5, lr=2e-2, margin=4.0, dropout=0.0).losses
    assert losses[0] > 0 and losses[-1] < losses[0]


def test_odd_features(spark, rows):
    odd = spark.createDataFrame(
        [(1000, 0, None), (1001, 1, [1.0]), (1002, 2, [float("nan")] * 4), (1003, 0, [1.0, None, 2.0, 3.0])],
        "row_id long, label long, features array<double>",
    )
    both = rows.unionByName(odd)
    options = dict(dim=8, hidden=(16, 8), epochs=2, lr=1e-2, margin=4.0, dropout=0.0)
    trained = con.fit_contrastive(both, ["label"], **options)
    out = con.embed(both, trained.weights).collect()
    assert len(out) == 196 and {r.row_id for r in out if r.embedding is None} == {1000, 1001, 1002, 1003}
