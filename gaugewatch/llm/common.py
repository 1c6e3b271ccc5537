"""What several operators of this folder need: tables, samples, sizes, Arrow helpers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDS = 5
SAMPLE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that learning never sees; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _training_labels(labels: DataFrame, label: str) -> DataFrame:
    """One label per id outside the held-out fold: of an id labelled both 0 and 1, the 1."""
    rows = labels.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("label_"))
    return rows.where(F.col("label_").isin(0, 1) & ~held_out("id_")).groupBy("id_").agg(F.max("label_").alias("label_"))


def label_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Ids labelled 0 and ids labelled 1 outside the held-out fold: what labelled_sample takes from, all of it."""
    rows = _training_labels(labels, label).groupBy("label_").count()
    found = {r["label_"]: r["count"] for r in rows.collect()}
    return found.get(0, 0), found.get(1, 0)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = SAMPLE_BYTES
) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) pairs of each class, of at most ``max_bytes``, outside the held-out fold.

    Rows are taken in the order of a hash of their id, so the sample does not
    depend on how the table is laid out. These two bounds are the only ones that
    learning has: statistics over the corpus are never taken from it.
    """
    rows = _training_labels(labels, label)
    picked = None
    for value in (0, 1):
        part = (
            rows.where(F.col("label_") == value)
            .orderBy(F.xxhash64("id_"), "id_")
            .limit(per_class)
        )
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class ids: a proven bound for the broadcast.
    found = docs.select(F.col("doc_id").alias("id_"), F.col("text").cast("string").alias("text_")).join(
        F.broadcast(picked), "id_"
    )
    # Of rows that repeat an id, one text: at most 2 * per_class rows reach the driver.
    got = found.where(F.col("text_").isNotNull()).groupBy("id_", "label_").agg(F.min("text_").alias("text_"))
    in_turn = Window.partitionBy("label_").orderBy(F.xxhash64("id_"), "id_")
    got = got.withColumn("bytes_", F.sum(F.octet_length("text_").cast("long")).over(in_turn)).where(F.col("bytes_") <= max_bytes)
    got = got.select("id_", "text_", "label_").toPandas().sort_values("id_")
    return list(zip(got["text_"], got["label_"].astype(int), strict=True))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the table: one scan, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def parts_for(size: int, each: int, least: int) -> int:
    return max(least, math.ceil(size / each))


def least_parts(spark: SparkSession) -> int:
    """Never fewer parts than cores, nor than the session shuffles into."""
    return max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """Each name, with as many underscores added as it takes not to clash (Spark ignores case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary Arrow array as bytes; null is empty."""
    return [v.encode() if isinstance(v, str) else v or b"" for v in column.to_pylist()]


def batches(rows: Iterable[pa.RecordBatch], size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds much more than ``size`` bytes of text."""
    for batch in rows:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            yield batch.slice(int(a), int(b - a))
