"""What searches share: usable vectors, the store's dimension, ranks of hits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewatch.functions.columns import is_usable
from gaugewatch.functions.vectors import usable_rows
from gaugewatch.session import fresh_path

HIT_SCHEMA = "query_id bigint, pattern_id bigint, distance double"


def usable_vectors(df: DataFrame, size: int | None) -> DataFrame:
    """Rows whose embedding has ``size`` finite values; the others can be neither searched nor found."""
    return df.filter(is_usable("embedding") & (F.size("embedding") == F.lit(size)))


def store_shape(patterns: DataFrame) -> tuple[int | None, int]:
    """The length that most usable vectors of the store have, the shorter of equals, and how many have it."""
    sizes = patterns.filter(is_usable("embedding")).groupBy(F.size("embedding").alias("size")).count()
    best = sizes.orderBy(F.desc("count"), "size").first()
    return (best["size"], best["count"]) if best else (None, 0)


def store_dim(patterns: DataFrame) -> int | None:
    return store_shape(patterns)[0]


def unusable_counts(df: DataFrame, size: int) -> DataFrame:
    """How many vectors a search for ``size`` values leaves out, by reason."""
    reason = (
        F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != size, "other size")
        .when(~is_usable("embedding"), "not finite").otherwise("usable")
    )
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stored_vectors(df: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """``columns`` of the rows that can be searched, written once: a long pipeline before them runs once.

    The check lies in the Arrow task, as a filter would repeat the whole
    expression that makes the embedding.
    """
    path = fresh_path(df.sparkSession, "vectors")
    rows = df.select(*columns, F.col("embedding").cast("array<double>").alias("embedding"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            known, _ = usable_rows(batch.column("embedding"), size)
            yield batch.take(pa.array(known.astype(np.int64)))

    rows.mapInArrow(check, rows.schema).write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def best_hits(hits: DataFrame, k: int, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Merge the parts of all blocks; at most ``k`` rows per query and block arrive here."""
    best = Window.partitionBy(*group).orderBy("distance", "pattern_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
