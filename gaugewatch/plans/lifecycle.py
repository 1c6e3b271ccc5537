"""Queries over what changes with time: trained embeddings in a store, and feedback that reaches it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.functions.network import Weights
from gaugewatch.operators import answers, detect, embedder, profile_states
from gaugewatch.plans import profiles
from gaugewatch.plans import tables as t
from gaugewatch.plans.tables import r
from gaugewatch.plans.verdicts import THRESHOLD, _rules_cte, _semantic_cte, feedback_rows
from gaugewatch.session import fresh_path
from gaugewatch.sources import pattern_store

# --- trained embeddings -----------------------------------------------------------------------

# A network whose weights follow from a formula, so that SQL can repeat it.
SIZES = (64, 12, 8, 6)
EMBEDDED_THRESHOLD = 0.05


def _weight(layer: int, i: str | np.ndarray, j: str | np.ndarray):
    """Between -0.5 and 0.5, for arrays and, as text, for SQL."""
    if isinstance(i, str):
        return f"((({i} * {7 + layer} + {j} * {3 + 2 * layer} + {layer}) % 11) - 5) / 10::double"
    return (((i * (7 + layer) + j * (3 + 2 * layer) + layer) % 11) - 5) / 10


def formula_embedder() -> embedder.Embedder:
    layers = []
    for n, (size, out) in enumerate(zip(SIZES, SIZES[1:])):
        i, j = np.meshgrid(np.arange(size), np.arange(out), indexing="ij")
        layers += [_weight(n, i, j), _weight(n, np.full(out, size), np.arange(out))]
    return embedder.embedder_of(Weights(*layers, np.ones(SIZES[-1]), np.zeros(SIZES[-1])))


def _layer_sql(n: int, x: str) -> str:
    size, out = SIZES[n], SIZES[n + 1]
    total = f"list_sum([{x}[i + 1] * {_weight(n, 'i', 'j')} for i in range({size})]) + {_weight(n, str(size), 'j')}"
    return f"[{total if n == 2 else f'greatest({total}, 0)'} for j in range({out})]"


# The vectors with their trained embeddings in place of the plain ones.
EMBEDDED = f"""{t.VECTORS.replace('vectors AS', 'plain AS', 1)},
first AS (SELECT vec_id, {_layer_sql(0, 'x')} AS h FROM (SELECT vec_id, [v::double for v in embedding] AS x FROM plain)),
second AS (SELECT vec_id, {_layer_sql(1, 'h')} AS h FROM first),
third AS (SELECT vec_id, {_layer_sql(2, 'h')} AS z FROM second),
normed AS (SELECT vec_id, [(v - list_avg(z)) / sqrt(list_avg([(w - list_avg(z)) * (w - list_avg(z)) for w in z]) + 1e-5) for v in z] AS e FROM third),
vectors AS MATERIALIZED (SELECT plain.* REPLACE (e AS embedding) FROM plain JOIN normed USING (vec_id))"""


def embed_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors through a stored network, read again by its version."""
    path = fresh_path(spark, "weights")
    made = formula_embedder()
    embedder.save_embedder(spark, made, path)
    loaded = embedder.load_embedder(spark, path, made.version)
    rows = t.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    out = embedder.embed_rows(rows, loaded)
    return t.tidy(out.select("vec_id", F.posexplode("embedding").alias("place", "value")))


EMBED_FORMULA = f"""WITH {EMBEDDED}
SELECT vec_id, place, {r('embedding[place + 1]')} AS value FROM vectors, range({SIZES[-1]}) AS p(place)"""


def _odd(df: DataFrame, row_id: str) -> DataFrame:
    return df.filter(F.pmod(row_id, F.lit(2)) == 1)


def _even(df: DataFrame, row_id: str) -> DataFrame:
    return df.filter(F.pmod(row_id, F.lit(2)) == 0)


def detect_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of odd id against a store of the even ones, both embedded by one network."""
    made, path = formula_embedder(), fresh_path(spark, "store")
    as_features = lambda df: df.withColumn("features", F.col("embedding").cast("array<double>")).drop("embedding")
    known = embedder.embed_rows(as_features(_even(t.vector_patterns(spark, sf_dir), "pattern_id")), made)
    pattern_store.append_to_store(known, path)
    samples = as_features(_odd(t.vector_queries(spark, sf_dir), "query_id"))
    found = embedder.detect_embedded(samples, pattern_store.read_store(spark, path), made, threshold=EMBEDDED_THRESHOLD)
    return t.tidy(found.select("query_id", "is_anomaly", "confidence", "anomaly_type", "explanation"))


def _verdict_sql(vectors: str, store: str, threshold: float) -> str:
    """The distance rules for odd vectors and the patterns of ``store``."""
    return f"""WITH {vectors}, {store},
pairs AS MATERIALIZED (
  SELECT a.vec_id AS query_id, b.pattern_id, a.host_id AS own_host, b.host_id, a.activity AS own_activity,
         b.activity, b.is_anomaly, b.anomaly_type, b.description, b.explanation,
         list_sum(list_transform(list_zip(a.embedding, b.embedding),
                  lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) AS distance
  FROM vectors a, store b WHERE a.vec_id % 2 = 1){t.HOST_FIRST.removeprefix(t.PAIRS)}, {_semantic_cte(threshold)}, {_rules_cte(threshold)}
SELECT query_id, is_anomaly, {r('confidence')} AS confidence, anomaly_type, explanation FROM rules"""


_EVEN = """SELECT vec_id AS pattern_id, embedding, host_id, activity, is_anomaly, anomaly_type, description, explanation
  FROM vectors WHERE vec_id % 2 = 0"""
DETECT_EMBEDDED = _verdict_sql(EMBEDDED, f"store AS ({_EVEN})", EMBEDDED_THRESHOLD)


# --- feedback in the store ------------------------------------------------------------------------


def _reviewed_store(spark: SparkSession, sf_dir: str) -> str:
    """A store of the even vectors after all feedback, with a run that died halfway and one run too many."""
    path = fresh_path(spark, "store")
    pattern_store.append_to_store(_even(t.vector_patterns(spark, sf_dir), "pattern_id"), path)
    log = feedback_rows(spark, sf_dir)
    made = pattern_store.waiting_patterns(spark, path, log)
    pattern_store.write_batch(made.patterns, path, made.ledger)  # died before its last write
    pattern_store.apply_feedback(spark, path, log)
    pattern_store.apply_feedback(spark, path, log.unionByName(log))
    return path


def detect_after_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from a store that reviewers have added to."""
    known = pattern_store.read_store(spark, _reviewed_store(spark, sf_dir))
    samples = _odd(t.vector_queries(spark, sf_dir), "query_id")
    found = detect.detect(samples, known, threshold=THRESHOLD)
    return t.tidy(found.select("query_id", "is_anomaly", "confidence", "anomaly_type", "explanation"))


_REVIEWED = f"""store AS (
  {_EVEN}
  UNION ALL
  SELECT (SELECT max(vec_id) FROM vectors WHERE vec_id % 2 = 0) + row_number() OVER (ORDER BY event_id), embedding, host_id, activity,
         event_type = 'error', CASE WHEN event_type = 'error' THEN CASE WHEN value > 20 THEN 'technical' ELSE 'unknown' END END,
         CASE WHEN event_type = 'click' THEN 'Looks fine'
              WHEN event_type = 'purchase' THEN 'Normal pattern confirmed through user feedback' END,
         CASE WHEN event_type = 'error' THEN 'Anomaly identified through user feedback' END
  FROM events JOIN vectors ON event_id = vec_id WHERE event_type IN ('click', 'error', 'purchase'))"""
DETECT_AFTER_FEEDBACK = _verdict_sql(t.VECTORS, _REVIEWED, THRESHOLD)


def store_after_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern of the reviewed store, with its whole vector."""
    known = pattern_store.read_store(spark, _reviewed_store(spark, sf_dir))
    return t.tidy(known.select(
        "pattern_id", "host_id", "activity", "is_anomaly", "anomaly_type", "description", "explanation",
        F.array_join(F.transform("embedding", lambda v: F.round(v * 1e6).cast("bigint").cast("string")), ",").alias("vector"),
    ))


STORE_AFTER_FEEDBACK = f"""WITH {t.VECTORS}, {_REVIEWED}
SELECT pattern_id, host_id, activity, is_anomaly, anomaly_type, description, explanation,
       array_to_string([round(v::double * 1e6)::bigint for v in embedding], ',') AS vector FROM store"""

# --- answers as a ledger -------------------------------------------------------------------------------


def answers_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about every event; a service that fails for every prompt once is asked in two runs.

    The first run may ask once, the second up to three times; the service only
    answers prompts that it has refused before, and never answers errors.
    """
    events = t.read(spark, sf_dir, "events")
    told = F.concat_ws(" ", F.lit("What does"), "event_type", F.lit("of"), F.round("value", 2).cast("string"), F.lit("mean?"))
    prompts = events.select(F.col("event_id").alias("query_id"), F.lit("contextual").alias("prompt_kind"), told.alias("prompt"))
    path = fresh_path(spark, "answers")

    def refuses(texts: list[str]) -> list[str]:
        raise ConnectionError("busy")

    def serves(texts: list[str]) -> list[str]:
        if any(" error " in text for text in texts):
            raise ValueError("no answer to errors")
        return [f"Heard: {text}" for text in texts]

    answers.ask_all(prompts, refuses, path, attempts=1)
    answers.ask_all(prompts, serves, path)
    answers.ask_all(prompts, refuses, path)  # nothing is left to ask
    every = answers.read_attempts(spark, path).groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"), F.max("answer").alias("answer"))
    return t.tidy(every)


ANSWERS_RETRIED = """SELECT event_id AS query_id, CASE event_type WHEN 'error' THEN 3 ELSE 2 END AS asked,
       CASE WHEN event_type <> 'error' THEN 'Heard: What does ' || event_type || ' of ' || round(value, 2)::varchar || ' mean?' END AS answer
FROM events"""


# --- profiles by slice ------------------------------------------------------------------------------

DAY, YEAR = 10, 4  # characters of a reading's time


def _saved_by_slice(spark: SparkSession, df: DataFrame, make, size: int = DAY, time: str = "timestamp") -> DataFrame:
    """States of all slices: the odd ones in one job, the even ones in a second, and some of them once more."""
    path, day = fresh_path(spark, "states"), F.substring(time, 1, size)
    number = F.substring(day, size - 1, 2).cast("int")
    for part in (number % 2 == 1, number % 2 == 0, number % 4 == 0):
        states = make(df.filter(part), day)
        profile_states.save_states(states, path)
    return profile_states.load_states(spark, path, states.schema)


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all sensors from the states of single days."""
    return t.tidy(profile_states.merge_sensor_states(_saved_by_slice(spark, t.readings(spark, sf_dir), profile_states.sensor_states)))


KEYS = ["node_id", "subsystem", "sensor", "parameter"]


def dataset_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _saved_by_slice(spark, t.readings(spark, sf_dir), lambda df, day: profile_states.combo_states(df, day, KEYS))
    return t.tidy(profile_states.merge_combo_states(made, KEYS))


def template_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of wide readings, by the year of their orders."""
    make = lambda df, day: profile_states.number_states(df, day, t.WIDE_SENSORS)
    return t.tidy(profile_states.merge_number_states(_saved_by_slice(spark, t.wide(spark, sf_dir), make, YEAR), t.WIDE_SENSORS))


QUERIES = {
    "answers_retried": (answers_retried, ANSWERS_RETRIED),
    "profile_merged": (profile_merged, profiles.SENSOR_PROFILE),
    "dataset_stats_merged": (dataset_stats_merged, profiles.DATASET_STATS),
    "template_stats_merged": (template_stats_merged, profiles.TEMPLATE_STATS),
    "embed_formula": (embed_formula, EMBED_FORMULA),
    "detect_embedded": (detect_embedded, DETECT_EMBEDDED),
    "detect_after_feedback": (detect_after_feedback, DETECT_AFTER_FEEDBACK),
    "store_after_feedback": (store_after_feedback, STORE_AFTER_FEEDBACK),
}
