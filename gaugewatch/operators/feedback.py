"""Reviewer feedback: counts, recent entries, and its way back into the patterns.

The log is append-only. Which entries were used is kept in a ledger of ids, so
no table is overwritten while it is read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewatch.operators.patterns import labelled_patterns

# Notes for entries without any.
ANOMALY_NOTE = "Anomaly identified through user feedback"
NORMAL_NOTE = "Normal pattern confirmed through user feedback"


def _flags() -> tuple[Column, Column]:
    said = F.coalesce("detection.is_anomaly", F.lit(False))
    true = F.coalesce("user_feedback.actual_anomaly", F.lit(False))
    return said, true


def confusion_counts(df: DataFrame) -> DataFrame:
    said, true = _flags()
    return df.agg(
        F.count(F.lit(1)).alias("total_feedback_entries"),
        F.count_if(said & ~true).alias("false_positives"),
        F.count_if(~said & true).alias("false_negatives"),
        F.count_if(said & true).alias("confirmed_anomalies"),
        F.count_if(~said & ~true).alias("confirmed_normals"),
        F.max("timestamp").alias("last_update"),
    )


def feedback_stats(df: DataFrame) -> DataFrame:
    """Confusion counts and their percentages of all entries; 0 for an empty log."""
    total = F.col("total_feedback_entries")

    def percent(part: Column) -> Column:
        return F.coalesce(F.try_divide(part, total) * 100, F.lit(0.0))

    return confusion_counts(df).withColumns(
        {
            "false_positive_rate": percent(F.col("false_positives")),
            "false_negative_rate": percent(F.col("false_negatives")),
            "accuracy": percent(F.col("confirmed_anomalies") + F.col("confirmed_normals")),
        }
    )


def recent_feedback(df: DataFrame, limit: int = 10) -> DataFrame:
    """Newest entries first; each task keeps at most ``limit`` of them."""
    return df.orderBy(F.desc("timestamp"), "feedback_id").limit(limit)


class Processed(NamedTuple):
    """New pattern rows, ledger rows to append, and (total, processed, failed)."""

    patterns: DataFrame
    ledger: DataFrame
    counts: DataFrame


def process_feedback(feedback: DataFrame, ledger: DataFrame) -> Processed:
    """Turn waiting entries into patterns.

    An entry needs a sample and a stated truth. ``ledger`` holds the ids used
    so far; rows of ``patterns`` carry the ``feedback_id`` they came from.
    """
    waiting = feedback.filter(~F.coalesce("processed", F.lit(False))).join(
        ledger.select("feedback_id"), "feedback_id", "left_anti"
    )
    usable = F.col("sample").isNotNull() & F.col("user_feedback.actual_anomaly").isNotNull()
    ready = waiting.filter(usable).select("feedback_id", "sample.*", "user_feedback")
    truth = F.col("user_feedback.actual_anomaly")
    note = F.col("user_feedback.notes")
    kind = F.coalesce("user_feedback.anomaly_type", F.lit("unknown"))
    patterns = labelled_patterns(
        ready, truth, kind, F.coalesce(note, F.lit(ANOMALY_NOTE)), F.coalesce(note, F.lit(NORMAL_NOTE))
    ).drop("user_feedback")
    counts = waiting.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(usable).alias("processed"),
        F.count_if(~usable).alias("failed"),
    )
    return Processed(patterns, waiting.filter(usable).select("feedback_id"), counts)


def mark_processed(feedback: DataFrame, ledger: DataFrame) -> DataFrame:
    """The log with ``processed`` set for every id in the ledger."""
    used = ledger.select("feedback_id").distinct().withColumn("_used", F.lit(True))
    return (
        feedback.join(used, "feedback_id", "left")
        .withColumn("processed", F.coalesce("processed", F.lit(False)) | F.coalesce("_used", F.lit(False)))
        .drop("_used")
    )
