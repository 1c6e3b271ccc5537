"""Rows dealt into shards that all have the corpus's mixture of sources.

Inside each stratum (a source) rows get a rank in the order of a seeded hash:
the shuffle. Row number r of a stratum of n rows then stands at the fraction
``(r + u) / n``, where u is a hash of the stratum between 0 and 1, so that
strata with a single row do not all stand at one place. All rows are sorted by
their fraction and cut at multiples of one k-th of all rows. Any stretch of the
order holds each stratum's share of rows, give or take one, and shards differ
by one row at most.

Neither rank needs one stratum, nor the whole order, in one task: both orders
are cut into ranges of bounded size (of the hash, and of the fraction, which
are near uniform), ranked there, and shifted by the counts of the ranges
before. Only these counts are small tables; rows move twice.

The order depends on the seed, the id and the text alone, so the layout of the
input and repeated tasks change nothing. Rows with equal id and text are dealt
like any others; each input row gives one result row. Equal texts under
different ids are not kept together: the law is ``rows``. A null stratum is a
stratum of its own, a null text has size 1 and the checksum of nothing, and an
empty table gives an empty result. Extra columns are carried as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewatch.llm.common import free_names
from gaugewatch.session import fresh_path

SHARDS = 8
SEED = 7
DIGITS = 13  # hexadecimal digits of a hash that a double holds exactly
UNIT = 16**DIGITS
RANGE_ROWS = 16_384


def _number(text: Column) -> Column:
    """52 bits of an md5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _strata(by: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(by).cast("string")), F.lit("n"))


def _range(value: Column, unit: float, ranges: int) -> Column:
    """Number of the range that holds a value between 0 and ``unit``."""
    return F.least(F.floor(value.cast("double") / F.lit(float(unit)) * F.lit(ranges)), F.lit(ranges - 1)).cast("long")


def _ordered(rows: DataFrame, by: list[str], key: Column, order: list[str], ranges: int, name: str) -> DataFrame:
    """Add the place of each row (from 0) in its group, and the group's size as ``{name}_of``."""
    ranged = rows.withColumn("range_", key if ranges > 1 else F.lit(0).cast("long"))
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and range that holds rows: a group has at most ``ranges`` of them.
    shifts = (
        ranged.groupBy(*by, "range_").agg(F.count(F.lit(1)).alias("rows_"))
        .withColumn("shift_", F.coalesce(F.sum("rows_").over(before), F.lit(0)))
        .withColumn(f"{name}_of", F.sum("rows_").over(Window.partitionBy(*by)))
        .drop("rows_")
    )
    inside = Window.partitionBy(*by, "range_").orderBy(*order)
    ranked = ranged.withColumn("at_", F.row_number().over(inside) - 1)
    return ranked.join(shifts, [*by, "range_"]).withColumn(name, F.col("at_") + F.col("shift_")).drop("at_", "shift_", "range_")


def assign(
    docs: DataFrame, carried: list[str], shards: int = SHARDS, seed: int = SEED, by: str = "source", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """doc_id, size, text_crc32, the ``carried`` columns as a struct ``row_``, shard and slot of every row.

    ``size`` is the text's bytes and one more; ``slot`` counts from 0 in each shard.
    """
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    identity = F.concat_ws(
        "/", F.lit(str(seed)), F.coalesce(docs["doc_id"].cast("string"), F.lit("none")), F.coalesce(F.concat(F.lit("t"), text), F.lit("n"))
    )
    path = fresh_path(spark, "sharding")
    docs.select(
        F.struct(F.lit(0).alias("none_"), *[docs[c] for c in carried]).alias("row_"),
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        _strata(by).alias("stratum_"),
        _number(identity).alias("key_"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.count()
    ranges = max(1, math.ceil(total / range_rows))
    ties = ["key_", "doc_id", "text_crc32", "size"]
    within = _ordered(rows, ["stratum_"], _range(F.col("key_"), UNIT, ranges), ties, ranges, "rank_")
    start = _number(F.concat(F.lit(f"{seed}/"), F.col("stratum_"))).cast("double") / F.lit(float(UNIT))
    placed = within.withColumn("fraction_", (F.col("rank_") + start) / F.col("rank__of")).withColumn("all_", F.lit(0))
    order = ["fraction_", "stratum_", *ties]
    ordered = _ordered(placed, ["all_"], _range(F.col("fraction_"), 1.0, ranges), order, ranges, "place_")
    # Integers throughout: shard s begins at the first place not below s * total / shards.
    shard = F.expr(f"(place_ * {int(shards)}L) div {max(total, 1)}L")
    begin = F.expr(f"((place_ * {int(shards)}L) div {max(total, 1)}L * {total}L + {int(shards) - 1}L) div {int(shards)}L")
    return ordered.select(
        "doc_id", "size", "text_crc32", "row_", shard.cast("int").alias("shard"), (F.col("place_") - begin).alias("slot")
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, by: str = "source") -> DataFrame:
    """``docs`` with two more columns, ``shard_`` and ``slot_`` (more underscores if the names are taken)."""
    shard, slot = free_names(docs.columns, "shard_", "slot_")
    dealt = assign(docs, docs.columns, shards, seed, by)
    return dealt.select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias(shard), F.col("slot").alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, by: str = "source", file_rows: int = 100_000) -> None:
    """Whole rows as Parquet, one folder per shard, files in the order of slots with ``file_rows`` rows each."""
    dealt = assign(docs, docs.columns, shards, seed, by).withColumn("file", F.floor(F.col("slot") / F.lit(file_rows)))
    names = [F.col(f"row_.`{c}`").alias(c) for c in docs.columns]
    shard, slot, file = free_names(docs.columns, "shard_", "slot_", "file_")
    (
        dealt.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
        .select(*names, F.col("shard").alias(shard), F.col("slot").alias(slot), F.col("file").alias(file))
        .write.partitionBy(shard, file).parquet(path)
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    return assign(docs, []).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS x,
    coalesce('s' || source, 'n') AS stratum,
    ('0x' || substr(md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '/' || coalesce('t' || text, 'n')), 1, {DIGITS}))::BIGINT AS key
  FROM documents),
c AS (
  SELECT d.*, xor(list_reduce(
    [CAST('0x' || substr(x, 2 * p + 1, 2) AS BIGINT) for p in range(len(x) // 2)],
    lambda a, b : xor(a // 256, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, text_crc32, size) - 1
    + CAST(('0x' || substr(md5('{SEED}/' || stratum), 1, {DIGITS}))::BIGINT AS DOUBLE) / {float(UNIT)})
    / count(*) OVER (PARTITION BY stratum) AS fraction FROM c),
p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id NULLS FIRST, text_crc32, size) - 1 AS place,
    count(*) OVER () AS n FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(place * {SHARDS} // n AS INTEGER) AS shard,
  CAST(place - (place * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
