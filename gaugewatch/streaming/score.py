"""Readings scored as they arrive, with the same functions as in batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugewatch.functions.columns import epoch_seconds
from gaugewatch.operators.detect import detect
from gaugewatch.sources.readings import RAW_COLUMNS


def stream_readings(
    spark: SparkSession, path: str, max_files: int = 1000, unique: Sequence[str] | None = None
) -> DataFrame:
    """New reading files of a folder, every row of them, however late it comes.

    With ``unique``, rows that repeat these columns are left out; name all that
    identify a reading. The seen keys are then state for as long as the stream
    lives: nothing is dropped for being late. Files must have the columns of
    raw readings in their order; another header is an error.
    """
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    raw = reader.option("maxFilesPerTrigger", max_files).csv(path)
    timed = raw.withColumn("seen_at", F.timestamp_seconds(epoch_seconds("timestamp")))
    return timed.dropDuplicates(list(unique)) if unique else timed


def score_stream(
    readings: DataFrame,
    to_samples: Callable[[DataFrame], DataFrame],
    load_patterns: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Append the rule verdicts of every micro-batch to ``out``.

    ``load_patterns`` is called per batch, so patterns learnt from feedback
    count from the next batch on. A batch that is run again after a failure
    replaces its own folder.
    """

    def score(batch: DataFrame, number: int) -> None:
        verdicts = detect(to_samples(batch), load_patterns(), **options)
        verdicts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        readings.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
