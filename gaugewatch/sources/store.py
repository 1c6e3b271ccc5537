"""Pattern and feedback tables on disk; both only ever grow by appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN_SCHEMA = """
    pattern_id bigint, embedding array<double>, host_id string, activity string, ts string,
    is_anomaly boolean, anomaly_type string, description string, explanation string,
    readings map<string,double>
"""

FEEDBACK_SCHEMA = """
    feedback_id string, timestamp string,
    sample struct<host_id: string, activity: string, ts: string,
                  readings: map<string,double>, embedding: array<double>>,
    detection struct<is_anomaly: boolean, confidence: double>,
    user_feedback struct<correct: boolean, actual_anomaly: boolean, anomaly_type: string, notes: string>,
    processed boolean
"""


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def save_patterns(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], PATTERN_SCHEMA)
    return spark.read.parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(path)


def import_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON list files; a file that cannot be read gives none."""
    files = spark.read.option("wholetext", True).text(path)
    entry = spark.createDataFrame([], FEEDBACK_SCHEMA).schema
    entries = F.from_json("value", T.ArrayType(entry), {"mode": "PERMISSIVE"})
    return files.select(F.inline(entries)).filter(F.col("feedback_id").isNotNull())


def clear_feedback(spark: SparkSession, path: str, stamp: str, backup: bool = True) -> str | None:
    """Empty the log; with ``backup`` copy it to ``<path>.<stamp>.bak`` first."""
    copy = f"{path}.{stamp}.bak"
    if backup and _exists(spark, path):
        read_feedback(spark, path).write.mode("errorifexists").parquet(copy)
    spark.createDataFrame([], FEEDBACK_SCHEMA).write.mode("overwrite").parquet(path)
    return copy if backup else None
