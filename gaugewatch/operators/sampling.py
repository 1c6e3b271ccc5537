"""Seeded samples, holdouts and changed rows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.functions.columns import shuffled_order
from gaugewatch.operators.scale import first_n, rank_in_groups

STATE_ROWS = 100_000  # rows a task holds before it reduces them


def head_rows(df: DataFrame, n: int, order: str = "ingest_id") -> DataFrame:
    """The first rows in ingest order; each task keeps at most ``n``."""
    return df.orderBy(order).limit(n)


def sample_per_node(
    df: DataFrame, n: int, seed: int = 42, by: str = "node_id", row_id: str = "ingest_id"
) -> DataFrame:
    """``n`` rows per node in a seeded order; nodes with fewer rows give all of them."""
    keyed = df.withColumn("_order", shuffled_order(row_id, seed))
    return first_n(keyed, [by], ["_order", row_id], n, spread=[row_id]).drop("_order", "rank")


def sample_bottom_k(
    df: DataFrame, n: int, seed: int = 42, by: str = "node_id", row_id: str = "ingest_id", tasks_per_lane: int = 256
) -> DataFrame:
    """The rows of ``sample_per_node`` as an aggregate: states of at most ``n`` rows per node, merged without a sort.

    A task reduces its rows to the ``n`` least of each node as they come. With
    many tasks their states meet in lanes first, so that no task gets the
    states of all others, however frequent a node is.
    """
    keyed = df.withColumn("_order", shuffled_order(row_id, seed))
    schema = T.StructType([*keyed.schema.fields, T.StructField("_lane", T.IntegerType())])

    def least(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(by, "ascending"), ("_order", "ascending"), (row_id, "ascending")])
        codes = pc.dictionary_encode(table[by].take(order), null_encoding="encode").combine_chunks()
        code = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        place = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
        return table.take(order.take(pa.array(np.flatnonzero(place < n))))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() // tasks_per_lane
        held, size, bound = [], 0, STATE_ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > bound:
                held = least(pa.Table.from_batches(held)).to_batches()
                size = sum(b.num_rows for b in held)
                bound = max(STATE_ROWS, 2 * size)
        if held:
            table = least(pa.Table.from_batches(held))
            yield from table.append_column("_lane", pa.array(np.full(table.num_rows, lane, np.int32))).to_batches()

    states = keyed.mapInArrow(partial, schema)
    if keyed.rdd.getNumPartitions() > tasks_per_lane:
        states = states.groupBy(by, "_lane").applyInArrow(least, schema)
    return states.groupBy(by).applyInArrow(least, schema).drop("_order", "_lane")


def split_holdout(
    df: DataFrame, frac: float = 0.1, by: str = "node_id", order: str = "ingest_id"
) -> DataFrame:
    """Mark the last ``max(1, int(n * frac))`` rows of every node.

    ``holdout_position`` counts from 0 inside the holdout, NULL outside.
    """
    ranked = rank_in_groups(df, [by], [order])
    held = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(frac)))
    place = F.col("position") - (F.col("group_size") - held)
    return (
        ranked.withColumn("holdout_position", F.when(place >= 0, place))
        .withColumn("is_holdout", F.col("holdout_position").isNotNull())
        .drop("position", "group_size")
    )


def inject_anomalies(
    df: DataFrame, up: float = 2.5, down: float = 0.4, values: str = "values"
) -> DataFrame:
    """Scale held-out values up at even positions and down at odd ones."""
    factor = F.when(F.col("holdout_position") % 2 == 0, F.lit(up)).otherwise(F.lit(down))
    changed = F.transform(values, lambda v: v * factor)
    return df.withColumn(values, F.when(F.col("is_holdout"), changed).otherwise(F.col(values)))


def append_scaled_last(
    df: DataFrame, factor: float = 3.0, order: str = "ingest_id", values: str = "values"
) -> DataFrame:
    """Add a copy of the last row with scaled values; the copy is marked ``is_added``."""
    last = df.orderBy(F.desc(order)).limit(1)
    scaled = last.withColumn(values, F.transform(values, lambda v: v * F.lit(factor)))
    return df.withColumn("is_added", F.lit(False)).unionByName(scaled.withColumn("is_added", F.lit(True)))
