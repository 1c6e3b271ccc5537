"""Joins, ranks and pairings that hold when one key carries a third of all rows.

* ``dimension_join`` broadcasts a side only after measuring it; beyond the bound
  hot keys are cut into parts, and only their dimension rows are repeated.
* ``first_n`` and ``rank_in_groups`` never put a whole hot group into one task.
* ``pair_blocks`` hands two sides to Arrow tasks in blocks of bounded size and
  lets the task keep what it needs; pairs are never written out as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.session import cut

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
HOT_ROWS = 1_000_000
MAX_HOT_BROADCAST = 100_000
SPLIT_BYTES = 128 << 20
# Above this row limit Spark does not push row_number() <= n below the shuffle.
GROUP_LIMIT_PUSHDOWN = 1000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast; its text size bounds the binary size.

    Rows and bytes are added up where they lie: no rows meet in one task.
    """
    size = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes"),
    ).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few small files over all cores, ahead of work that is heavy per row.

    One file is read by one task. Inputs with enough files or bytes for every
    core already are left alone, so a large job gets no extra shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df._jdf.inputFiles()  # stays on the JVM: a large table has many names
    if not len(files) or len(files) >= cores:
        return df
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(files[i]) for i in range(len(files))]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df if size >= cores * SPLIT_BYTES else df.repartition(cores)


def _hot_keys(facts: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """All keys with more than ``hot_rows`` rows and the parts to cut them into.

    There are at most (rows / ``hot_rows``) of them.
    """
    counts = facts.na.drop(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > hot_rows).select(*on, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_parts"))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType)


def _content_hash(df: DataFrame) -> Column:
    """A number from a row's own values: the same again when a lost task is repeated."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not _has_map(f.dataType)])


def dimension_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join facts with a dimension on equal keys; ``how`` is left or inner.

    A measured small dimension is broadcast. Otherwise all keys of the facts
    above ``hot_rows`` are cut into parts and only their dimension rows are
    repeated. Facts without a key match nothing and take no part in the join.
    """
    on = list(on)
    if is_small(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    rest = [c for c in facts.columns if c not in on] + [c for c in dim.columns if c not in on]
    keyed = facts.na.drop(subset=on)
    hot = cut(_hot_keys(facts, on, hot_rows))
    hot_count = hot.count()
    if not hot_count:
        # No key needs parts: a plain shuffle holds at most ``hot_rows`` rows of a key.
        met = keyed.join(dim, on, how)
    else:
        hot = F.broadcast(hot) if hot_count <= MAX_HOT_BROADCAST else hot
        parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1).cast("array<bigint>")
        repeated = dim.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
        part = F.pmod(_content_hash(facts), F.coalesce("_parts", F.lit(1)))
        met = keyed.join(hot, on, "left").withColumn("_part", part).drop("_parts").join(repeated, on + ["_part"], how)
    met = met.select(*on, *rest)
    if how != "left":
        return met
    # Rows without a key stay where they are; nothing of them is shuffled.
    missing = facts.filter(reduce(or_, [F.col(c).isNull() for c in on]))
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema.fields if f.name not in on]
    return met.unionByName(missing.select("*", *lacking).select(*on, *rest))


def first_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    n: int,
    rank: str = "rank",
    spread: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    Small limits are cut per input partition by Spark before the shuffle. For
    larger limits the ``spread`` columns (a row id) cut each group into salted
    parts first, as many as the number of rows asks for, so a hot group is
    reduced in parallel.
    """
    within = Window.partitionBy(*by).orderBy(*order)
    if n > GROUP_LIMIT_PUSHDOWN and spread:
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        salts = max(1, math.ceil(df.count() / max(HOT_ROWS, 10 * n)))
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
            .withColumn("_part", F.row_number().over(part))
            .filter(F.col("_part") <= n)
            .drop("_salt", "_part")
        )
    return df.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= n)


def rank_in_groups(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """Add ``position`` (0-based within the group) and ``group_size``.

    Large inputs are dealt into ranges of the whole key: group, ``order`` and,
    for rows that are equal in these, their place in the input. Each range is
    ranked on its own and shifted by the counts of the ranges before it, so no
    task sees a whole hot group, nor all rows with one value.
    """
    by, order = list(by), list(order)
    ranges = math.ceil(df.count() / rows_per_range)
    if ranges <= 1:
        group = Window.partitionBy(*by)
        return df.withColumn(
            "position", (F.row_number().over(group.orderBy(*order)) - 1).cast("bigint")
        ).withColumn("group_size", F.count(F.lit(1)).over(group))

    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(ranges, *by, *order, "_tie").withColumn("_range", F.spark_partition_id())
    # Written once: a second run of the same plan may draw other borders.
    ranged = cut(dealt)

    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*by, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("group_size", F.sum("_rows").over(group))
        .drop("_rows")
    )
    keys = by + ["_range"]
    shifts = shifts.select(*[F.col(c).alias(f"_on_{c}") for c in keys], "_shift", "group_size")
    match = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in keys]
    ranked = ranged.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_tie")) - 1)
    return (
        ranked.join(shifts, match)
        .withColumn("position", (F.col("_row") + F.col("_shift")).cast("bigint"))
        .drop("_row", "_shift", "_range", "_tie", *[f"_on_{c}" for c in keys])
    )


def _block_counts(df: DataFrame, by: list[str], rows: int, name: str) -> DataFrame | int:
    """Blocks per key, listing only keys that need more than one."""
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name)
    if not by:
        return df.agg(blocks).first()[0]
    return df.groupBy(*by).agg(blocks).filter(F.col(name) > 1)


def _with_blocks(df: DataFrame, by: list[str], counts: DataFrame | int, name: str) -> DataFrame:
    if isinstance(counts, int):
        return df.withColumn(name, F.lit(max(counts, 1)))
    joined = dimension_join(df, counts, by)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def _with_known_blocks(df: DataFrame, by: list[str], blocks: Sequence[tuple]) -> DataFrame:
    if not blocks:
        return df.withColumns({"_lefts": F.lit(1), "_rights": F.lit(1)})
    fields = [df.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in ("_lefts", "_rights")]
    known = df.sparkSession.createDataFrame(list(blocks), T.StructType(fields))
    joined = df.join(F.broadcast(known), by, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(1)) for c in ("_lefts", "_rights")})


def pair_blocks(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_id: str,
    right_id: str,
    work: Callable,
    schema: str,
    left_rows: int = 20_000,
    right_rows: int = 20_000,
    blocks: Sequence[tuple] | None = None,
) -> DataFrame:
    """Meet every left row with every right row of its key inside Arrow tasks.

    A key with many rows is cut into hashed blocks on both sides; each pair of
    blocks is one group of at most about ``left_rows`` and ``right_rows`` rows.
    ``work(key, left, right)`` gets two Arrow tables and returns its result.
    ``blocks`` spares the counts where they are known: (key..., left blocks,
    right blocks) of the keys with more than one, a list of bounded length.
    """
    by = list(by)
    if blocks is None:
        left_counts = _block_counts(left, by, left_rows, "_lefts")
        right_counts = _block_counts(right, by, right_rows, "_rights")
        left = _with_blocks(_with_blocks(left, by, left_counts, "_lefts"), by, right_counts, "_rights")
        right = _with_blocks(_with_blocks(right, by, left_counts, "_lefts"), by, right_counts, "_rights")
    else:
        left, right = (_with_known_blocks(side, by, blocks) for side in (left, right))

    def block(row_id: str, count: str) -> Column:
        return F.pmod(F.xxhash64(row_id), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = left.withColumn("_lb", block(left_id, "_lefts")).withColumn("_rb", every("_rights"))
    right = right.withColumn("_rb", block(right_id, "_rights")).withColumn("_lb", every("_lefts"))
    keys = [f"_on_{c}" for c in by] + ["_lb", "_rb"]

    def grouped(side: DataFrame) -> GroupedData:
        # Fresh names on both sides: they may come from one and the same table.
        rest = [F.col(c).alias(c) for c in side.columns if c not in ("_lefts", "_rights")]
        return side.select(*[F.col(c).alias(f"_on_{c}") for c in by], *rest).groupBy(*keys)

    return grouped(left).cogroup(grouped(right)).applyInArrow(work, schema)
