"""Trained embeddings in use: weights as a table with a version, and detection that refuses to mix versions.

An embedder is a network and the name of its weights (a hash of their values).
The same forward pass embeds patterns and queries, and each embedded row carries
the version, so a store of one network is never searched with another.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.functions.network import Weights
from gaugewatch.operators.contrastive import embed, fit_contrastive
from gaugewatch.operators.detect import detect

VERSION = "embedding_version"
WEIGHT_SCHEMA = "version string, layer string, row int, values array<double>"


class VersionMismatch(ValueError):
    """Patterns and queries were embedded by different networks."""


class Embedder(NamedTuple):
    weights: Weights
    version: str


def embedder_of(weights: Weights) -> Embedder:
    held = Weights(*(np.ascontiguousarray(w, np.float64) for w in weights))
    named = hashlib.sha256(b"".join(repr(w.shape).encode() + w.tobytes() for w in held))
    return Embedder(held, named.hexdigest()[:16])


def fit_embedder(df: DataFrame, labels: list[str], **options) -> Embedder:
    """Train on (row_id, features, label columns); the options are those of ``fit_contrastive``."""
    return embedder_of(fit_contrastive(df, labels, **options).weights)


def save_embedder(spark: SparkSession, embedder: Embedder, path: str) -> None:
    """Add the weights to the table at ``path``; a version that it has already is left alone."""
    rows = [
        (embedder.version, name, i, [float(v) for v in values])
        for name, layer in zip(Weights._fields, embedder.weights, strict=True) for i, values in enumerate(np.atleast_2d(layer))
    ]
    # One folder per version, replaced as a whole: a run that died halfway is repeated safely.
    spark.createDataFrame(rows, WEIGHT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{embedder.version}")


def load_embedder(spark: SparkSession, path: str, version: str) -> Embedder:
    rows = spark.read.schema(WEIGHT_SCHEMA).parquet(f"{path}/{version}").orderBy("layer", "row").collect()  # of the network's size
    layers = {name: np.array([r["values"] for r in rows if r["layer"] == name]) for name in Weights._fields}
    flat = {name: layer if name.startswith("w") else layer[0] for name, layer in layers.items()}
    loaded = embedder_of(Weights(**flat))
    if loaded.version != version:
        raise VersionMismatch(f"the weights at {path} are {loaded.version}, not {version}")
    return loaded


def embed_rows(df: DataFrame, embedder: Embedder) -> DataFrame:
    """Add ``embedding`` and its version to rows with ``features``: the one way in, for patterns and for queries."""
    return embed(df.drop(VERSION), embedder.weights).withColumn(VERSION, F.lit(embedder.version))


def check_version(patterns: DataFrame, embedder: Embedder) -> None:
    """Refuse patterns of another network, or of none; only the version column is read."""
    found = [r[0] for r in patterns.select(VERSION).distinct().limit(3).collect()] if VERSION in patterns.columns else [None]
    if set(found) - {embedder.version}:
        raise VersionMismatch(f"the queries' network is {embedder.version}, the patterns have {sorted(map(str, found))}")


def detect_embedded(samples: DataFrame, patterns: DataFrame, embedder: Embedder, answers: DataFrame | None = None, **options) -> DataFrame:
    """``detect`` on samples with ``features`` and a store that ``embedder`` embedded."""
    check_version(patterns, embedder)
    return detect(embed_rows(samples, embedder), patterns, answers, **options)
