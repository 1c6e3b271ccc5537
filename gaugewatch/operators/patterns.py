"""The table of known patterns: building, appending, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewatch.operators.scale import rank_in_groups

PATTERN_COLUMNS = [
    "embedding", "host_id", "activity", "ts", "is_anomaly",
    "anomaly_type", "description", "explanation", "readings",
]


def _text(c: Column | str | None) -> Column:
    if c is None:
        return F.lit(None).cast("string")
    return F.lit(c) if isinstance(c, str) else c


def _pattern(df: DataFrame, is_anomaly: Column, **texts: Column) -> DataFrame:
    """Samples (host_id, activity, ts, readings, embedding) as pattern rows; other columns stay."""
    return df.withColumns(
        {
            "host_id": F.coalesce(F.col("host_id").cast("string"), F.lit("unknown")),
            "activity": F.coalesce(F.col("activity").cast("string"), F.lit("unknown")),
            "ts": F.coalesce(F.col("ts").cast("string"), F.lit("")),
            "is_anomaly": is_anomaly,
            **texts,
        }
    )


def normal_patterns(df: DataFrame, description: Column | str | None = None) -> DataFrame:
    text = F.coalesce(_text(description), F.lit("Normal sensor pattern"))
    return _pattern(df, F.lit(False), anomaly_type=_text(None), description=text, explanation=_text(None))


def anomaly_patterns(df: DataFrame, anomaly_type: Column | str, explanation: Column | str) -> DataFrame:
    return _pattern(
        df, F.lit(True), anomaly_type=_text(anomaly_type), description=_text(None), explanation=_text(explanation)
    )


def labelled_patterns(
    df: DataFrame,
    is_anomaly: Column,
    anomaly_type: Column | str,
    explanation: Column | str,
    description: Column | str | None = None,
) -> DataFrame:
    """Normal and anomaly patterns in one pass; ``is_anomaly`` tells them apart row by row."""
    text = F.coalesce(_text(description), F.lit("Normal sensor pattern"))
    return _pattern(
        df,
        is_anomaly,
        anomaly_type=F.when(is_anomaly, _text(anomaly_type)),
        description=F.when(~is_anomaly, text),
        explanation=F.when(is_anomaly, _text(explanation)),
    )


def add_patterns(patterns: DataFrame, new: DataFrame, dim: int, order: str) -> DataFrame:
    """New rows with ids after the highest one in the store, in the order of ``order``.

    A row whose embedding has another size stops the job.
    """
    last = patterns.agg(F.max("pattern_id")).first()[0]
    start = -1 if last is None else last
    ranked = rank_in_groups(new, [], [order])
    wrong = F.concat(
        F.lit(f"embedding size differs from {dim}: "), F.coalesce(F.size("embedding"), F.lit(-1)).cast("string")
    )
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
        F.raise_error(wrong).cast("array<double>")
    )
    return ranked.withColumn("embedding", checked).select(
        (F.col("position") + start + 1).alias("pattern_id"), *PATTERN_COLUMNS
    )


def pattern_stats(patterns: DataFrame) -> DataFrame:
    """Vectors, their dimension and how many rows have metadata, as one row."""
    return patterns.agg(
        F.count("embedding").alias("total_vectors"),
        F.max(F.size("embedding")).alias("dimension"),
        F.lit("flat").alias("index_type"),
        F.count("host_id").alias("metadata_count"),
        (F.count("embedding") > 0).alias("is_trained"),
    )
