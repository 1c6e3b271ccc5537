"""Feature vectors, simple embeddings and labels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewatch.constants import WIDE_ID_COLUMNS
from gaugewatch.functions.columns import epoch_seconds, parse_values, shuffled_number, tile_embedding
from gaugewatch.operators.clean import numeric_columns
from gaugewatch.operators.scale import rank_in_groups


def wide_features(df: DataFrame, id_cols: list[str] = WIDE_ID_COLUMNS) -> DataFrame:
    """Numeric columns sorted by name, NULLs left out; no reading gives ten zeros."""
    cols = sorted(numeric_columns(df, id_cols))
    if cols:
        found = F.array_compact(F.array(*[F.col(c).cast("double") for c in cols]))
    else:
        found = F.array().cast("array<double>")
    zeros = F.array_repeat(F.lit(0.0), 10)
    return df.withColumn("features", F.when(F.size(found) > 0, found).otherwise(zeros))


def reading_features(df: DataFrame, include_time: bool = True, column: str = "value") -> DataFrame:
    """The epoch and the parsed values; rows without a usable value or time are dropped."""
    values = parse_values(column)
    if include_time:
        epoch = F.col("unix_time") if "unix_time" in df.columns else epoch_seconds("timestamp")
        features = F.concat(F.array(epoch.cast("double")), values)
        usable = values.isNotNull() & (F.size(values) > 0) & epoch.isNotNull()
    else:
        features, usable = values, values.isNotNull() & (F.size(values) > 0)
    return df.filter(usable).withColumn("features", features)


def pad_features(df: DataFrame, column: str = "features") -> DataFrame:
    """Fill every vector with zeros up to the longest one."""
    longest = df.agg(F.max(F.size(column))).first()[0] or 0
    missing = F.lit(longest) - F.size(column)
    return df.withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(0.0), missing)))


def with_embedding(df: DataFrame, dim: int, column: str = "features") -> DataFrame:
    return df.withColumn("embedding", tile_embedding(column, dim))


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as an ML vector; what is no number becomes NaN."""
    typed = df.withColumns({f"_{c}": F.col(c).cast("string").try_cast("double") for c in cols})
    stage = VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol="features", handleInvalid="keep")
    return stage.transform(typed).drop(*[f"_{c}" for c in cols])


def l2_normalise(df: DataFrame, column: str = "features") -> DataFrame:
    """ML vectors divided by their length, as arrays in ``normalized_features``."""
    stage = Normalizer(inputCol=column, outputCol="_unit", p=2.0)
    return stage.transform(df).withColumn("normalized_features", vector_to_array("_unit")).drop("_unit")


def closest_divisor(n: int, target: int, mode: str = "any") -> int | None:
    """The divisor of ``n`` nearest to ``target``; ``mode`` any, smaller or larger."""
    if n == 0 or target <= 0:
        raise ValueError("n must not be 0 and target must be positive")
    if mode not in ("any", "smaller", "larger"):
        raise ValueError("mode must be any, smaller or larger")
    n = abs(n)
    root = math.isqrt(n)
    below = next(d for d in range(min(n, target), 0, -1) if n % d == 0)
    # Divisors beyond the root are those of small cofactors.
    above = next((d for d in range(target, root + 1) if n % d == 0), None)
    if above is None and target <= n:
        above = next(n // c for c in range(min(n // target, root), 0, -1) if n % c == 0)
    if mode == "smaller" or (mode == "any" and (above is None or target - below <= above - target)):
        return below
    return above


def assign_batches(
    df: DataFrame, target: int = 64, mode: str = "any", seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Equal batches over a seeded order of all rows; their size divides the number of rows."""
    size = closest_divisor(df.count(), target, mode)
    return _in_order(df, seed, row_id, lambda position, rows: F.floor(position / F.lit(size)))


def near_equal_batches(df: DataFrame, target: int = 64, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Batches of about ``target`` rows over a seeded order, whatever the number of rows.

    Sizes differ by one at most, so no batch is left with too few rows for pairs.
    """
    batches = F.greatest(F.lit(1), F.round(F.col("group_size") / target)).cast("bigint")
    return _in_order(df, seed, row_id, lambda position, rows: F.floor(position * batches / rows))


def _in_order(df: DataFrame, seed: int, row_id: str, batch: Callable[[Column, Column], Column]) -> DataFrame:
    keyed = df.withColumn("_order", shuffled_number(row_id, seed))
    ranked = rank_in_groups(keyed, [], ["_order", row_id])
    numbered = ranked.withColumn("batch_id", batch(F.col("position"), F.col("group_size")).cast("bigint"))
    return numbered.drop("_order", "position", "group_size")
