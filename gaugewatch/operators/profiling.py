"""Listings, statistics and profiles; every one is a partial/final aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewatch.operators.clean import SENSOR_KEYS
from gaugewatch.operators.scale import dimension_join
from gaugewatch.session import cut


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of each column as (column, value) rows, in one pass."""
    if len(columns) == 1:
        return df.select(columns[0]).filter(F.col(columns[0]).isNotNull()).distinct()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    listed = df.select(*columns).distinct().select(F.explode(pairs).alias("p")).select("p.*")
    return listed.filter(F.col("value").isNotNull()).distinct()


def dataset_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, columns, distinct counts of ``keys`` and missing cells, as one row.

    Rows are first counted per key combination, so that the distinct counts
    work on that far smaller table.
    """
    cells = len(df.columns)
    missing = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    combos = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(missing).alias("_missing"))
    totals = combos.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_samples"),
        F.lit(cells).alias("columns"),
        *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys],
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_values"),
    )
    share = F.try_divide(F.col("missing_values") * 100.0, F.col("total_samples") * cells)
    return totals.withColumn("missing_percentage", F.coalesce(share, F.lit(0.0)))


def sensor_profile(df: DataFrame, order: str = "ingest_id") -> DataFrame:
    """Minimum, maximum, mean and population deviation per sensor.

    A group with a value that is no number has no statistics; it shows its
    first value as text and NA for the rest. The large aggregate only holds
    numbers, so it runs hashed without a sort; the few first values are looked
    up by their ids afterwards, and only if there is a textual group.
    """

    def side(column: str, suffix: str) -> list:
        number = F.col(column).try_cast("double")
        textual = F.max(F.col(column).isNotNull() & number.isNull())
        return [
            F.min(number).alias(f"min_value{suffix}"),
            F.max(number).alias(f"max_value{suffix}"),
            F.avg(number).alias(f"mean_value{suffix}"),
            F.stddev_pop(number).alias(f"std_value{suffix}"),
            F.coalesce(textual, F.lit(False)).alias(f"_text{suffix}"),
        ]

    grouped = cut(
        df.groupBy(*SENSOR_KEYS).agg(
            F.count(F.lit(1)).alias("readings"), F.min(order).alias("_first"),
            *side("value_hrf", ""), *side("value_raw", "_raw"),
        )
    ).withColumn("textual", F.col("_text") | F.col("_text_raw"))
    wanted = grouped.filter("textual").select(F.col("_first").alias(order))
    firsts = dimension_join(df.select(order, "value_hrf", "value_raw"), wanted, [order], "inner").select(
        F.col(order).alias("_first"),
        F.col("value_hrf").alias("first_value"), F.col("value_raw").alias("first_value_raw"),
    )
    return profile_columns(grouped.join(firsts, "_first", "left"))


def profile_columns(grouped: DataFrame) -> DataFrame:
    """The columns of a profile: no statistics where a group is textual."""
    out = [F.concat_ws("_", *SENSOR_KEYS).alias("id"), *SENSOR_KEYS, "readings", "textual"]
    for suffix in ("", "_raw"):
        for stat in ("min", "max", "mean", "std"):
            name = f"{stat}_value{suffix}"
            out.append(F.when(~F.col("textual"), F.col(name)).alias(name))
        out.append(f"first_value{suffix}")
    return grouped.select(*out)


def template_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample deviation per numeric column, as (name, mean, std) rows."""
    aggs = [f(c).alias(f"{n}:{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    row = df.agg(*aggs)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(f"`mean:{c}`").alias("mean"), F.col(f"`std:{c}`").alias("std"))
            for c in cols
        ]
    )
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def load_counts(patterns: DataFrame, by: str = "host_id") -> DataFrame:
    """Samples, normal patterns and anomalies per node."""
    return patterns.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~F.col("is_anomaly")).alias("patterns"),
        F.count_if(F.col("is_anomaly")).alias("anomalies"),
    )
