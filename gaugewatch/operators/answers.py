"""Model answers as a ledger: every attempt is a row, and only prompts without an answer are asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.operators.detect import ask_model
from gaugewatch.session import cut
from gaugewatch.sources.store import _exists

KEYS = ["query_id", "prompt_kind"]
LEDGER_SCHEMA = "query_id bigint, prompt_kind string, attempt int, answer string, error string"


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER_SCHEMA)


def answers_of(attempts: DataFrame) -> DataFrame:
    """(query_id, prompt_kind, answer, attempts): the first answer of every prompt that has one."""
    some = F.col("answer").isNotNull()
    told = attempts.groupBy(*KEYS).agg(
        F.min_by("answer", F.when(some, F.col("attempt"))).alias("answer"), F.max("attempt").alias("attempts")
    )
    return told.filter(F.col("answer").isNotNull())


def ask_all(
    prompts: DataFrame, generate: Callable[[list[str]], list[str]], path: str, attempts: int = 3
) -> DataFrame:
    """Ask until every prompt has an answer or was asked ``attempts`` times; returns the answers there are.

    The ledger at ``path`` decides: a rerun, also after a failure, goes on with
    the prompts that lack an answer. Of rows that share query and kind, the
    prompt that sorts first is asked.
    """
    spark = prompts.sparkSession
    single = cut(prompts.groupBy(*KEYS).agg(F.min("prompt").alias("prompt")))
    for _ in range(attempts):
        tried = read_attempts(spark, path).groupBy(*KEYS).agg(
            F.max("attempt").alias("tries"), F.max(F.col("answer").isNotNull()).alias("answered")
        )
        state = single.join(tried, KEYS, "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
        waiting = cut(state.filter(~F.coalesce("answered", F.lit(False)) & (F.col("tries") < attempts)))
        if waiting.isEmpty():
            break
        told = ask_model(waiting, generate).join(waiting.select(*KEYS, "tries"), KEYS)
        told.select(*KEYS, (F.col("tries") + 1).cast("int").alias("attempt"), "answer", "error").write.mode("append").parquet(path)
    return answers_of(read_attempts(spark, path))
