"""A pattern store that grows by whole batches, and takes every feedback entry once.

Folders below the store's path:

* ``patterns/<batch>``: the rows of one batch,
* ``used/<batch>``: the feedback entries it came from, if any,
* ``batches``: one row per finished batch, written last.

Readers only see finished batches. A job that dies before its last write leaves
folders behind that nobody reads; its rerun finds the same entries waiting and
writes them as a batch of its own. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.operators.embedder import VERSION, Embedder, VersionMismatch, embed_rows
from gaugewatch.operators.feedback import Processed, process_feedback
from gaugewatch.operators.patterns import PATTERN_COLUMNS, add_patterns
from gaugewatch.sources.store import PATTERN_SCHEMA, _exists

STORE_SCHEMA = f"{PATTERN_SCHEMA.strip()}, {VERSION} string"
USED_SCHEMA = "feedback_id string"
BATCH_SCHEMA = "batch string, rows bigint"


def _batches(spark: SparkSession, path: str) -> list[str]:
    if not _exists(spark, f"{path}/batches"):
        return []
    return sorted(r["batch"] for r in spark.read.schema(BATCH_SCHEMA).parquet(f"{path}/batches").collect())


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    folders = [f for f in (f"{path}/{table}/{b}" for b in _batches(spark, path)) if _exists(spark, f)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of all finished batches."""
    return _read(spark, path, "patterns", STORE_SCHEMA)


def read_used(spark: SparkSession, path: str) -> DataFrame:
    """The feedback entries that finished batches have taken."""
    return _read(spark, path, "used", USED_SCHEMA)


def write_batch(rows: DataFrame, path: str, used: DataFrame | None = None) -> str:
    """Write a batch without finishing it; returns its name."""
    batch = uuid.uuid4().hex
    kept = rows if VERSION in rows.columns else rows.withColumn(VERSION, F.lit(None).cast("string"))
    kept.select("pattern_id", *PATTERN_COLUMNS, VERSION).write.parquet(f"{path}/patterns/{batch}")
    if used is not None:
        used.select("feedback_id").write.parquet(f"{path}/used/{batch}")
    return batch


def finish_batch(spark: SparkSession, path: str, batch: str) -> None:
    """The last write: one row in one file makes the batch part of the store."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(f"{path}/patterns/{batch}").count()
    spark.createDataFrame([(batch, rows)], BATCH_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/batches")


def append_to_store(rows: DataFrame, path: str) -> None:
    """Add pattern rows that have their ids already."""
    finish_batch(rows.sparkSession, path, write_batch(rows, path))


def store_version(patterns: DataFrame) -> str | None:
    """The network that embedded the patterns; several are refused."""
    found = [r[0] for r in patterns.select(VERSION).distinct().limit(2).collect()]
    if len(found) > 1:
        raise VersionMismatch(f"the store holds patterns of several networks: {found}")
    return found[0] if found else None


def waiting_patterns(spark: SparkSession, path: str, feedback: DataFrame, embedder: Embedder | None = None) -> Processed:
    """What ``feedback`` would add to the store: pattern rows with ids, entries used, and counts.

    Of entries that share an id, the earliest counts. With an ``embedder`` the
    samples' readings, in the order of their names, are embedded anew; it must
    be the store's. Without one, samples bring their embeddings.
    """
    known = read_store(spark, path)
    version = store_version(known)
    if known.limit(1).count() and version != (embedder.version if embedder else None):
        raise VersionMismatch(f"the store's network is {version}, the feedback's {embedder.version if embedder else None}")
    single = feedback.groupBy("feedback_id").agg(F.min_by(F.struct(*feedback.columns), "timestamp").alias("entry")).select("entry.*")
    made = process_feedback(single, read_used(spark, path))
    rows = made.patterns
    if embedder:
        named = F.array_sort(F.map_entries("readings"))
        rows = embed_rows(rows.withColumn("features", F.transform(named, lambda e: e["value"])), embedder).drop("features")
    size = known.select(F.max(F.size("embedding"))).first()[0]
    if size is None:
        size = rows.select(F.max(F.size("embedding"))).first()[0] or 0
    added = add_patterns(known, rows, size, "feedback_id")
    named = F.lit(version or (embedder.version if embedder else None)).cast("string")
    return Processed(added.withColumn(VERSION, named), made.ledger, made.counts)


def apply_feedback(spark: SparkSession, path: str, feedback: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Put waiting feedback into the store, each entry once however often this runs; returns the counts."""
    made = waiting_patterns(spark, path, feedback, embedder)
    counts = spark.createDataFrame(made.counts.collect(), made.counts.schema)  # one row, counted before the store changes
    if counts.first()["processed"]:
        finish_batch(spark, path, write_batch(made.patterns, path, made.ledger))
    return counts
