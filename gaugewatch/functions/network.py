"""The embedding network and its loss on one mini-batch, in NumPy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from gaugewatch.functions.vectors import matrix

EPS = 1e-8


def pair_sums(
    a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, same_row: np.ndarray,
    weights: list[float], margin: float,
) -> list[float]:
    """Summed pulls and pushes of all pairs, and the weights they count with."""
    far = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        diff = a[:, d][:, None] - b[:, d][None, :]
        far += diff * diff
    far = np.sqrt(far)
    pull = push = 0.0
    pulls = pushes = 0.0
    for j, w in enumerate(weights):
        same = la[:, j][:, None] == lb[:, j][None, :]
        pos, neg = same & ~same_row, ~same
        pull += w * far[pos].sum()
        pulls += w * pos.sum()
        push += w * np.maximum(margin - far, 0.0)[neg].sum()
        pushes += w * neg.sum()
    return [pull, pulls, push, pushes]


class Weights(NamedTuple):
    """Three linear layers and the final layer norm."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: np.ndarray
    gain: np.ndarray
    shift: np.ndarray


def initial_weights(inputs: int, dim: int, hidden: tuple[int, int], seed: int) -> Weights:
    draw = np.random.default_rng(seed)

    def layer(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
        bound = 1.0 / np.sqrt(n_in)
        return draw.uniform(-bound, bound, (n_in, n_out)), draw.uniform(-bound, bound, n_out)

    w1, b1 = layer(inputs, hidden[0])
    w2, b2 = layer(hidden[0], hidden[1])
    w3, b3 = layer(hidden[1], dim)
    return Weights(w1, b1, w2, b2, w3, b3, np.ones(dim), np.zeros(dim))


def forward(w: Weights, x: np.ndarray, masks: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Embeddings, and what the backward pass needs; ``masks`` are dropout factors."""
    h1 = np.maximum(x @ w.w1 + w.b1, 0.0)
    d1 = h1 * masks[0] if masks else h1
    h2 = np.maximum(d1 @ w.w2 + w.b2, 0.0)
    d2 = h2 * masks[1] if masks else h2
    z = d2 @ w.w3 + w.b3
    spread = np.sqrt(z.var(1, keepdims=True) + 1e-5)
    unit = (z - z.mean(1, keepdims=True)) / spread
    return unit * w.gain + w.shift, (x, h1, d1, h2, d2, unit, spread)


def batch_gradient(
    w: Weights, x: np.ndarray, labels: np.ndarray, weights: list[float],
    margin: float, lambda_neg: float, masks: tuple | None = None,
) -> tuple[float, Weights]:
    """Loss of one mini-batch and its gradient for every weight."""
    out, (x, h1, d1, h2, d2, unit, spread) = forward(w, x, masks)
    diff = out[:, None, :] - out[None, :, :]
    far = np.sqrt((diff * diff).sum(2))
    pos, neg = np.zeros_like(far), np.zeros_like(far)
    for j, weight in enumerate(weights):
        same = labels[:, j][:, None] == labels[:, j][None, :]
        pos += weight * same
        neg += weight * ~same
    np.fill_diagonal(pos, 0.0)
    pos /= pos.sum() + EPS
    neg /= neg.sum() + EPS
    loss = (far * pos).sum() + lambda_neg * (np.maximum(margin - far, 0.0) * neg).sum()

    pull = pos - lambda_neg * neg * (far < margin)
    pull = np.divide(pull + pull.T, far, out=np.zeros_like(far), where=far > 0)
    g_out = pull.sum(1)[:, None] * out - pull @ out
    g_unit = g_out * w.gain
    g_z = (g_unit - g_unit.mean(1, keepdims=True) - unit * (g_unit * unit).mean(1, keepdims=True)) / spread
    g_h2 = (g_z @ w.w3.T) * (masks[1] if masks else 1.0) * (h2 > 0)
    g_h1 = (g_h2 @ w.w2.T) * (masks[0] if masks else 1.0) * (h1 > 0)
    return loss, Weights(
        x.T @ g_h1, g_h1.sum(0), d1.T @ g_h2, g_h2.sum(0), d2.T @ g_z, g_z.sum(0),
        (g_out * unit).sum(0), g_out.sum(0),
    )


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([part.ravel() for part in w])


def unflat(values: np.ndarray, like: Weights) -> Weights:
    parts, at = [], 0
    for part in like:
        parts.append(values[at : at + part.size].reshape(part.shape))
        at += part.size
    return Weights(*parts)


def mini_batches(parts: Iterable[pa.RecordBatch]) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """Rows arrive sorted by batch; a mini-batch may span two Arrow batches."""
    held = None
    for part in parts:
        table = pa.Table.from_batches([part])
        held = table if held is None else pa.concat_tables([held, table])
        ids = held["batch_id"].to_numpy()
        if not len(ids):
            continue
        ends = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids))
        for start, end in zip(np.append(0, ends[:-2]), ends[:-1]):
            yield mini_batch(held.slice(start, end - start))
        held = held.slice(ends[-2] if len(ends) > 1 else 0)
    if held is not None and held.num_rows:
        yield mini_batch(held)


def mini_batch(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    return int(rows["batch_id"][0].as_py()), matrix(rows["features"]), matrix(rows["_labels"])
