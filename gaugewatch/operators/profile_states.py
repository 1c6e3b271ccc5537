"""Profiles that grow: partial states per slice of time, stored, and merged when they are asked for.

A slice is profiled once, when it arrives. Its state holds what merges exactly:
counts, least and greatest values, means with their sums of squared deviations,
first values, and the key combinations that occur. Saving a slice again replaces
its state, so a repeated job changes nothing. A merged profile reads the states
only, never the readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewatch.operators.clean import SENSOR_KEYS
from gaugewatch.operators.profiling import profile_columns

SLICE = "slice"
SIDES = {"value_hrf": "", "value_raw": "_raw"}


def _moments(number: Column, name: str) -> list[Column]:
    """Count, mean and sum of squared deviations of the numbers of a group."""
    n = F.count(number)
    return [n.alias(f"n{name}"), F.avg(number).alias(f"mean{name}"), (F.var_pop(number) * n).alias(f"squares{name}")]


def _merged_moments(states: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add each group's mean over all its states, and the part of each state in its sum of squared deviations."""
    group = Window.partitionBy(*keys)
    for name in names:
        n, mean = F.col(f"n{name}"), F.col(f"mean{name}")
        all_ = (F.sum(n * mean).over(group) / F.sum(n).over(group)).alias("m")
        states = states.withColumn(f"mean_all{name}", F.when(F.sum(n).over(group) > 0, all_))
        away = mean - F.col(f"mean_all{name}")
        states = states.withColumn(f"part{name}", F.col(f"squares{name}") + n * away * away)
    return states


def save_states(states: DataFrame, path: str) -> None:
    """Keep the states of their slices; slices that are there already are replaced, others are left alone."""
    writer = states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(SLICE).parquet(path)


def load_states(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# --- sensors ------------------------------------------------------------------------------


def sensor_states(df: DataFrame, slice_: Column, order: str = "ingest_id") -> DataFrame:
    """One row per slice and sensor."""
    aggs = [F.count(F.lit(1)).alias("readings"), F.min(order).alias("first_id")]
    for column, side in SIDES.items():
        number = F.col(column).try_cast("double")
        aggs += [
            *_moments(number, side), F.min(number).alias(f"min{side}"), F.max(number).alias(f"max{side}"),
            F.coalesce(F.max(F.col(column).isNotNull() & number.isNull()), F.lit(False)).alias(f"text{side}"),
            F.min_by(column, order).alias(f"first{side}"),
        ]
    return df.groupBy(slice_.alias(SLICE), *SENSOR_KEYS).agg(*aggs)


def merge_sensor_states(states: DataFrame) -> DataFrame:
    """What ``sensor_profile`` gives for all readings of all slices."""
    sides = list(SIDES.values())
    aggs = [F.sum("readings").alias("readings")]
    for side in sides:
        total = F.sum(f"n{side}")
        aggs += [
            F.min(f"min{side}").alias(f"min_value{side}"), F.max(f"max{side}").alias(f"max_value{side}"),
            F.max(f"mean_all{side}").alias(f"mean_value{side}"),
            F.when(total > 0, F.sqrt(F.sum(f"part{side}") / total)).alias(f"std_value{side}"),
            F.max(f"text{side}").alias(f"_text{side}"),
            # Of groups without ids in a slice, none comes first.
            F.min_by(F.struct(f"first{side}"), "first_id").getField(f"first{side}").alias(f"first_value{side}"),
        ]
    merged = _merged_moments(states, SENSOR_KEYS, sides).groupBy(*SENSOR_KEYS).agg(*aggs)
    merged = merged.withColumn("textual", F.col("_text") | F.col("_text_raw"))
    for side in sides:
        merged = merged.withColumn(f"first_value{side}", F.when(F.col("textual"), F.col(f"first_value{side}")))
    return profile_columns(merged)


# --- tables -----------------------------------------------------------------------------------


def combo_states(df: DataFrame, slice_: Column, keys: Sequence[str]) -> DataFrame:
    """One row per slice and combination of keys: its rows and missing cells."""
    missing = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.groupBy(slice_.alias(SLICE), *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(missing).alias("missing"), F.lit(len(df.columns)).alias("cells")
    )


def merge_combo_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``dataset_stats`` gives for all rows of all slices."""
    totals = states.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_samples"), F.coalesce(F.max("cells"), F.lit(0)).alias("columns"),
        *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys],
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_values"),
    )
    share = F.try_divide(F.col("missing_values") * 100.0, F.col("total_samples") * F.col("columns"))
    return totals.withColumn("missing_percentage", F.coalesce(share, F.lit(0.0)))


def number_states(df: DataFrame, slice_: Column, columns: Sequence[str]) -> DataFrame:
    """One row per slice: moments of every numeric column."""
    return df.groupBy(slice_.alias(SLICE)).agg(*[a for c in columns for a in _moments(F.col(c).cast("double"), f":{c}")])


def merge_number_states(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What ``template_stats`` gives for all rows of all slices: (name, mean, std)."""
    parts = F.array(*[
        F.struct(F.lit(c).alias("name"), *[F.col(f"`{k}:{c}`").alias(k) for k in ("n", "mean", "squares")]) for c in columns
    ])
    rows = states.select(F.explode(parts).alias("p")).select("p.*")
    total = F.sum("n")
    return _merged_moments(rows, ["name"], [""]).groupBy("name").agg(
        F.max("mean_all").alias("mean"), F.when(total > 1, F.sqrt(F.sum("part") / (total - 1))).alias("std")
    )
