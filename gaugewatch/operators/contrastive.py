"""Contrastive loss, its data-parallel training, and embedding with the result.

Training keeps the rows on the executors: each task sums the gradients of its
mini-batches, the sums are added up by parameter block on the cluster, and the
driver only sees one gradient of the model's own size per step.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.functions.columns import fit_dim, is_usable
from gaugewatch.functions.network import (
    EPS,
    Weights,
    batch_gradient,
    flat,
    forward,
    initial_weights,
    mini_batches,
    pair_sums,
    unflat,
)
from gaugewatch.functions.vectors import matrix, usable_rows
from gaugewatch.operators.features import near_equal_batches
from gaugewatch.operators.retrieval import store_dim
from gaugewatch.operators.scale import pair_blocks
from gaugewatch.session import cut

GRADIENT_BLOCK = 8192
TASKS_PER_SUM = 256
LOSS_SCHEMA = "batch_id bigint, pos_sum double, pos_weight double, neg_sum double, neg_weight double"


# --- loss over a table ------------------------------------------------------------


def contrastive_loss(
    df: DataFrame,
    labels: list[str],
    weights: list[float] | None = None,
    margin: float = 1.0,
    lambda_neg: float = 0.5,
    row_id: str = "row_id",
    tile_rows: int = 1024,
) -> DataFrame:
    """Loss per ``batch_id`` over (row_id, batch_id, embedding, label columns).

    Pairs are summed inside tasks, a large batch in tiles of ``tile_rows``.
    """
    weights = weights or [1.0] * len(labels)
    rows = df.select(
        F.col("batch_id").cast("bigint").alias("batch_id"), F.col(row_id).cast("bigint").alias("_id"), "embedding",
        F.array(*[F.col(c).cast("bigint") for c in labels]).alias("_labels"),
    )

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sums = [0.0] * 4
        if left.num_rows and right.num_rows:
            same_row = left["_id"].to_numpy()[:, None] == right["_id"].to_numpy()[None, :]
            sums = pair_sums(
                matrix(left["embedding"]), matrix(right["embedding"]),
                matrix(left["_labels"]), matrix(right["_labels"]), same_row, weights, margin,
            )
        columns = [pa.array([key[0].as_py()], pa.int64()), *[pa.array([float(s)]) for s in sums]]
        return pa.Table.from_arrays(columns, names=["batch_id", "pos_sum", "pos_weight", "neg_sum", "neg_weight"])

    parts = pair_blocks(rows, rows, ["batch_id"], "_id", "_id", tile, LOSS_SCHEMA, tile_rows, tile_rows)
    sums = ("pos_sum", "pos_weight", "neg_sum", "neg_weight")
    totals = parts.groupBy("batch_id").agg(*[F.sum(s).alias(s) for s in sums])
    pos = F.col("pos_sum") / (F.col("pos_weight") + EPS)
    neg = F.col("neg_sum") / (F.col("neg_weight") + EPS)
    return totals.withColumn("loss", pos + lambda_neg * neg)


# --- training -------------------------------------------------------------------------


class Trained(NamedTuple):
    weights: Weights
    losses: list[float]


def fit_contrastive(
    df: DataFrame,
    labels: list[str],
    dim: int = 128,
    hidden: tuple[int, int] = (1024, 512),
    epochs: int = 30,
    batch: int = 64,
    lr: float = 1e-3,
    margin: float = 1.0,
    lambda_neg: float = 0.5,
    dropout: float = 0.2,
    label_weights: list[float] | None = None,
    seed: int = 42,
    row_id: str = "row_id",
) -> Trained:
    """Train on (row_id, features, label columns).

    Rows are put into mini-batches of nearly ``batch`` rows once, stored with
    one part of them per task. In every epoch each task takes one Adam step
    per mini-batch of its part, all starting from the same weights; then the
    weights of all tasks are averaged. With one task this is plain Adam over
    all mini-batches. Every epoch reads all rows once.
    """
    weights = label_weights or [1.0] * len(labels)
    rows = df.select(
        F.col(row_id).alias("row_id"), "features",
        F.array(*[F.col(c).cast("bigint") for c in labels]).alias("_labels"),
    )
    # Rows that are no vector of the usual size teach nothing.
    dim_in = store_dim(rows.withColumnRenamed("features", "embedding"))
    rows = rows.filter(is_usable("features") & (F.size("features") == F.lit(dim_in)))
    batched = near_equal_batches(rows, batch, seed=seed)
    batched = cut(batched.repartition("batch_id").sortWithinPartitions("batch_id", "row_id"))
    tasks = batched.rdd.getNumPartitions()
    w = initial_weights(dim_in, dim, hidden, seed)
    state = _Adam(flat(w), np.zeros(flat(w).size), np.zeros(flat(w).size), 0.0)
    losses: list[float] = []
    for epoch in range(epochs):
        state, loss = _one_epoch(batched, w, state, weights, margin, lambda_neg, dropout, lr, (seed, epoch), tasks)
        losses.append(loss)
    return Trained(unflat(state.theta, w), losses)


class _Adam(NamedTuple):
    theta: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: float

    def step(self, gradient: np.ndarray, lr: float) -> _Adam:
        steps = self.steps + 1
        mean = 0.9 * self.mean + 0.1 * gradient
        square = 0.999 * self.square + 0.001 * gradient * gradient
        moved = lr * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.999**steps)) + 1e-8)
        return _Adam(self.theta - moved, mean, square, steps)


def _one_epoch(
    df: DataFrame, shape: Weights, state: _Adam, weights: list[float], margin: float, lambda_neg: float,
    dropout: float, lr: float, seed: tuple[int, int], tasks: int,
) -> tuple[_Adam, float]:
    """The averaged state of all tasks after their steps, and the mean loss.

    A task counts by its number of steps. With many tasks the sums are added
    up in lanes first; one state of the network's size reaches the driver.
    """
    shared = df.sparkSession.sparkContext.broadcast((shape, state))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        shape, own = shared.value
        taken, lost = 0, 0.0
        for batch_id, x, y in mini_batches(parts):
            w = unflat(own.theta, shape)
            masks = None
            if dropout:
                draw = np.random.default_rng([*seed, batch_id])
                masks = tuple(
                    (draw.random((len(x), part.shape[1])) >= dropout) / (1.0 - dropout) for part in (w.w1, w.w2)
                )
            loss, gradient = batch_gradient(w, x, y, weights, margin, lambda_neg, masks)
            own = own.step(flat(gradient), lr)
            taken, lost = taken + 1, lost + loss
        if taken:
            row = np.concatenate([own.theta, own.mean, own.square, [own.steps]]) * taken
            row = np.append(row, [lost, taken])
            blocks = np.array_split(row, range(GRADIENT_BLOCK, len(row), GRADIENT_BLOCK))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId() // TASKS_PER_SUM] * len(blocks), pa.int32()),
                    pa.array(range(len(blocks)), pa.int32()),
                    pa.array(blocks, pa.list_(pa.float64())),
                ],
                names=["lane", "block", "part"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table["part"]).sum(0)
        return table.slice(0, 1).set_column(2, "part", pa.array([total], pa.list_(pa.float64())))

    schema = "lane int, block int, part array<double>"
    parts_of_tasks = df.mapInArrow(run, schema)
    if tasks > TASKS_PER_SUM:
        parts_of_tasks = parts_of_tasks.groupBy("lane", "block").applyInArrow(add, schema)
    sums = parts_of_tasks.groupBy("block").applyInArrow(add, schema).toArrow()
    shared.unpersist()
    parts = dict(zip(sums["block"].to_pylist(), sums["part"].to_pylist()))
    if not parts:
        return state, 0.0
    total = np.concatenate([np.array(parts[i]) for i in range(len(parts))])
    theta, mean, square = np.split(total[:-3] / total[-1], 3)
    return _Adam(theta, mean, square, total[-3] / total[-1]), float(total[-2] / total[-1])


def embed(df: DataFrame, weights: Weights, dim: int | None = None) -> DataFrame:
    """Add ``embedding`` to rows with ``features``, one forward pass per Arrow batch.

    Rows whose features are NULL, of another length or not finite get NULL.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in df.columns if c != "embedding"]
    schema = df.select(*names).schema.add("embedding", T.ArrayType(T.DoubleType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            good, x = usable_rows(batch.column("features"), len(shared.value.w1))
            out = [None] * batch.num_rows
            for row, values in zip(good.tolist(), forward(shared.value, x)[0] if len(good) else []):
                out[row] = values
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, "embedding"]
            )

    done = df.select(*names).mapInArrow(run, schema)
    return done.withColumn("embedding", fit_dim("embedding", dim)) if dim else done
