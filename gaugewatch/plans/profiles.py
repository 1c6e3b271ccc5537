"""Queries over profiles, samples, features and batches, each with its SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.functions.columns import fit_dim, label_bucket, shuffled_number, squared_distance, tile_embedding
from gaugewatch.operators import clean, contrastive, features, profiling, sampling
from gaugewatch.plans import tables as t
from gaugewatch.plans.tables import r

# --- profiles --------------------------------------------------------------------------


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.distinct_values(t.readings(spark, sf_dir), "node_id", "subsystem", "sensor", "parameter")


DISTINCT_VALUES = f"""WITH {t.READINGS}
SELECT DISTINCT "column", value FROM (
  SELECT 'node_id' AS "column", node_id AS value FROM readings UNION ALL SELECT 'subsystem', subsystem FROM readings
  UNION ALL SELECT 'sensor', sensor FROM readings UNION ALL SELECT 'parameter', parameter FROM readings)
WHERE value IS NOT NULL"""


def distinct_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.distinct_values(t.wide(spark, sf_dir), "hostID", "activity")


DISTINCT_ACTIVITIES = f"""WITH {t.WIDE}
SELECT DISTINCT 'hostID' AS "column", hostID AS value FROM wide UNION ALL
SELECT DISTINCT 'activity', activity FROM wide"""


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["node_id", "subsystem", "sensor", "parameter"]
    return t.tidy(profiling.dataset_stats(t.readings(spark, sf_dir), keys))


DATASET_STATS = f"""WITH {t.READINGS}, s AS (
  SELECT count(*) AS total_samples, count(DISTINCT node_id) AS distinct_node_id,
         count(DISTINCT subsystem) AS distinct_subsystem, count(DISTINCT sensor) AS distinct_sensor,
         count(DISTINCT parameter) AS distinct_parameter,
         (count(*) * 8 - count(ingest_id) - count(timestamp) - count(node_id) - count(subsystem) - count(sensor)
          - count(parameter) - count(value_raw) - count(value_hrf))::bigint AS missing_values
  FROM readings)
SELECT *, 8::bigint AS columns, {r('missing_values * 100.0::double / (total_samples * 8)')} AS missing_percentage FROM s"""


def sensor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tidy(profiling.sensor_profile(t.readings(spark, sf_dir)))


def _profile_side(suffix: str) -> str:
    stats = ("min", "max", "mean", "std")
    parts = [f"CASE WHEN NOT textual THEN {r(name + suffix)} END AS {name}_value{suffix}" for name in stats]
    parts.append(f"CASE WHEN textual THEN first{suffix} END AS first_value{suffix}")
    return ", ".join(parts)


def _profile_aggs(column: str, suffix: str) -> str:
    n = f"try_cast({column} AS double)"
    return (
        f"min({n}) AS min{suffix}, max({n}) AS max{suffix}, avg({n}) AS mean{suffix}, stddev_pop({n}) AS std{suffix},"
        f" coalesce(bool_or({column} IS NOT NULL AND {n} IS NULL), false) AS text{suffix},"
        f" arg_min_null({column}, ingest_id) AS first{suffix}"
    )


SENSOR_PROFILE = f"""WITH {t.READINGS}, g AS (
  SELECT subsystem, sensor, parameter, count(*) AS readings, {_profile_aggs('value_hrf', '')},
         {_profile_aggs('value_raw', '_raw')}
  FROM readings GROUP BY subsystem, sensor, parameter), f AS (SELECT *, "text" OR text_raw AS textual FROM g)
SELECT concat_ws('_', subsystem, sensor, parameter) AS id, subsystem, sensor, parameter, readings, textual,
       {_profile_side('')}, {_profile_side('_raw')} FROM f"""


def template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tidy(profiling.template_stats(t.wide(spark, sf_dir), t.WIDE_SENSORS))


TEMPLATE_STATS = (
    f"WITH {t.WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std FROM wide"
        for c in t.WIDE_SENSORS
    )
)


# --- samples ---------------------------------------------------------------------------


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = clean.select_readings(t.readings(spark, sf_dir), subsystem="metsense", sensor="htu21d")
    return sampling.head_rows(chosen, 50).select("ingest_id", "node_id", "value_hrf")


HEAD_ROWS = f"""WITH {t.READINGS}
SELECT ingest_id, node_id, value_hrf FROM readings WHERE subsystem = 'metsense' AND sensor = 'htu21d'
ORDER BY ingest_id LIMIT 50"""


def sample_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_node(t.readings(spark, sf_dir), 50).select("ingest_id", "node_id")


SAMPLE_PER_NODE = f"""WITH {t.READINGS}
SELECT ingest_id, node_id FROM readings
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY md5('42:' || ingest_id::varchar), ingest_id) <= 50"""


def sample_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``sample_per_node``, by states that merge."""
    return sampling.sample_bottom_k(t.readings(spark, sf_dir), 50).select("ingest_id", "node_id")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = clean.reject_unparsed(t.readings(spark, sf_dir), "value_hrf")
    return sampling.split_holdout(usable)


HELD = f"""{t.PARSED},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingest_id) - 1 AS position,
         count(*) OVER (PARTITION BY node_id) AS n
  FROM parsed WHERE len(vals) > 0),
held AS (
  SELECT *, CASE WHEN position >= n - h THEN position - (n - h) END AS holdout_position
  FROM (SELECT *, greatest(1, floor(n * 0.1::double))::bigint AS h FROM placed))"""


def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.coalesce("holdout_position", F.lit(-1)).alias("holdout_position")
    return t.tidy(_held(spark, sf_dir).select("ingest_id", "node_id", "is_holdout", place))


SPLIT_HOLDOUT = f"""WITH {HELD}
SELECT ingest_id, node_id, holdout_position IS NOT NULL AS is_holdout,
       coalesce(holdout_position, -1) AS holdout_position FROM held"""


def inject_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = sampling.inject_anomalies(_held(spark, sf_dir))
    return t.tidy(changed.select("ingest_id", "is_holdout", F.get("values", F.lit(0)).alias("first_value")))


INJECT_ANOMALIES = f"""WITH {HELD}
SELECT ingest_id, holdout_position IS NOT NULL AS is_holdout,
       {r("vals[1] * CASE WHEN holdout_position IS NULL THEN 1 WHEN holdout_position % 2 = 0 THEN 2.5::double ELSE 0.4::double END")} AS first_value
FROM held"""


def append_scaled_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = clean.reject_unparsed(t.readings(spark, sf_dir), "value_hrf")
    added = sampling.append_scaled_last(usable)
    return t.tidy(added.select("ingest_id", "is_added", F.get("values", F.lit(0)).alias("first_value")))


APPEND_SCALED_LAST = f"""WITH {t.PARSED}, ok AS (SELECT * FROM parsed WHERE len(vals) > 0)
SELECT ingest_id, false AS is_added, {r('vals[1]')} AS first_value FROM ok UNION ALL
SELECT ingest_id, true, {r('vals[1] * 3.0')} FROM ok WHERE ingest_id = (SELECT max(ingest_id) FROM ok)"""


# --- features -----------------------------------------------------------------------------


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.wide_features(t.wide(spark, sf_dir))
    weighted = F.aggregate(
        F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return t.tidy(f.select("uuid", F.size("features").alias("n"), weighted.alias("weighted")))


_WEIGHTED = "list_sum(list_transform({0}, lambda v, i: v * i))"
WIDE_FEATURES = f"""WITH {t.WIDE_EMBEDDED}
SELECT uuid, len(features) AS n, {r(_WEIGHTED.format('features'))} AS weighted FROM embedded"""


def reading_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.reading_features(t.readings(spark, sf_dir), column="value_hrf")
    padded = features.pad_features(f)
    return t.tidy(
        padded.select(
            "ingest_id", F.size("features").alias("n"),
            *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(3)],
        )
    )


READING_FEATURES = f"""WITH {t.PARSED}
SELECT ingest_id, (1 + (SELECT max(len(vals)) FROM parsed))::bigint AS n, unix_time::double AS f0, vals[1] AS f1,
       coalesce(vals[2], 0.0::double) AS f2 FROM parsed WHERE len(vals) > 0"""


def tile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.wide_features(t.wide(spark, sf_dir))
    e = f.withColumn("e", tile_embedding("features", t.WIDE_DIM))
    weighted = F.aggregate(F.transform("e", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return t.tidy(e.select("uuid", F.size("e").alias("n"), weighted.alias("weighted")))


TILE_VECTORS = f"""WITH {t.WIDE_EMBEDDED}
SELECT uuid, len(embedding) AS n, {r(_WEIGHTED.format('embedding'))} AS weighted FROM embedded"""


def fit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of 8 or 9 values brought to 9 (filled) and to 4 (cut)."""
    f = features.wide_features(t.wide(spark, sf_dir)).select(
        "uuid", fit_dim("features", 9).alias("long"), fit_dim("features", 4).alias("short")
    )
    zero = F.array_repeat(F.lit(0.0), 9)
    return t.tidy(
        f.select(
            "uuid", F.size("long").alias("n_long"), F.size("short").alias("n_short"),
            F.get("long", F.lit(8)).alias("ninth"), F.get("short", F.lit(3)).alias("fourth"),
            squared_distance("long", zero).alias("square"),
        )
    )


FIT_VECTORS = f"""WITH {t.WIDE_EMBEDDED}
SELECT uuid, 9::bigint AS n_long, 4::bigint AS n_short, {r('coalesce(features[9], 0.0::double)')} AS ninth,
       {r('features[4]')} AS fourth, {r('list_sum(list_transform(features, lambda v: v * v))')} AS square FROM embedded"""


def assemble_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch, value and raw count as a vector and as a unit vector; no number becomes NaN."""
    timed = clean.with_epoch(t.readings(spark, sf_dir))
    unit = features.l2_normalise(features.assemble(timed, ["unix_time", "value_hrf", "value_raw"]))
    raw = vector_to_array("features")

    def shown(c):
        return F.when(~F.isnan(c), c)

    return t.tidy(
        unit.select(
            "ingest_id", shown(F.get(raw, F.lit(1))).alias("value"), shown(F.get(raw, F.lit(2))).alias("count"),
            (shown(F.get("normalized_features", F.lit(1))) * 1e9).alias("unit_value"),
        ),
        4,
    )


ASSEMBLE_VECTORS = f"""WITH {t.READINGS}, v AS (
  SELECT ingest_id, epoch(strptime(timestamp, '%Y/%m/%d %H:%M:%S'))::double AS e, try_cast(value_hrf AS double) AS value,
         try_cast(value_raw AS double) AS count FROM readings)
SELECT ingest_id, value, count, {r('value / sqrt(e * e + value * value + count * count) * 1e9', 4)} AS unit_value FROM v"""


def label_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.readings(spark, sf_dir).na.fill("unknown", ["sensor"])
    return df.select("ingest_id", *[label_bucket(c).alias(c) for c in ("subsystem", "sensor", "parameter")])


LABEL_BUCKETS = f"""WITH {t.READINGS} SELECT ingest_id, """ + ", ".join(
    f"('0x' || substr(md5(coalesce({c}, 'unknown')), 1, 8))::bigint % 100 AS {c}" for c in ("subsystem", "sensor", "parameter")
) + " FROM readings"


# --- batches and learning -------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    return e.withColumn("parity", F.col("label") % 2).withColumn("third", F.col("label") % 3)


BATCHES = """sized AS (
  SELECT d AS size FROM (SELECT unnest(range(1, (SELECT count(*) FROM embeddings) + 1)) AS d)
  WHERE (SELECT count(*) FROM embeddings) % d = 0 ORDER BY abs(d - 64), d LIMIT 1),
batched AS (
  SELECT vec_id AS row_id, embedding, label,
         (row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || vec_id::varchar), 1, 15))::bigint, vec_id) - 1)
         // (SELECT size FROM sized) AS batch_id
  FROM embeddings)"""


def assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tidy(features.assign_batches(_vectors(spark, sf_dir)).select("row_id", "batch_id"))


ASSIGN_BATCHES = f"WITH {BATCHES} SELECT row_id, batch_id FROM batched"

MARGIN = 1.5


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = features.assign_batches(_vectors(spark, sf_dir))
    return t.tidy(contrastive.contrastive_loss(batched, ["label"], margin=MARGIN))


def contrastive_loss_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = features.assign_batches(_vectors(spark, sf_dir))
    return t.tidy(
        contrastive.contrastive_loss(batched, ["label", "parity", "third"], [1.0, 0.5, 0.25], margin=MARGIN)
    )


def _loss_sql(labels: dict[str, float]) -> str:
    pos = " + ".join(f"(row_a <> row_b AND ({e.format('a')}) = ({e.format('b')}))::int * {w}::double" for e, w in labels.items())
    neg = " + ".join(f"(({e.format('a')}) <> ({e.format('b')}))::int * {w}::double" for e, w in labels.items())
    return f"""WITH {BATCHES}, far AS (
  SELECT a.batch_id, a.row_id AS row_a, b.row_id AS row_b, a.label AS label_a, b.label AS label_b,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
              lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) AS d
  FROM batched a JOIN batched b ON a.batch_id = b.batch_id),
sums AS (
  SELECT batch_id, sum(d * ({pos})) AS pos_sum, sum({pos}) AS pos_weight,
         sum(greatest({MARGIN}::double - d, 0) * ({neg})) AS neg_sum,
         sum({neg}) AS neg_weight
  FROM far GROUP BY batch_id)
SELECT batch_id, {r('pos_sum')} AS pos_sum, {r('pos_weight')} AS pos_weight, {r('neg_sum')} AS neg_sum,
       {r('neg_weight')} AS neg_weight,
       {r('pos_sum / (pos_weight + 1e-8) + 0.5 * (neg_sum / (neg_weight + 1e-8))')} AS loss FROM sums"""


CONTRASTIVE_LOSS = _loss_sql({"label_{0}": 1.0})
CONTRASTIVE_LOSS_LABELS = _loss_sql({"label_{0}": 1.0, "label_{0} % 2": 0.5, "label_{0} % 3": 0.25})


def fit_contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train a small network on all vectors and embed them: rows by label, and whether the loss fell."""
    rows = _vectors(spark, sf_dir).withColumnRenamed("embedding", "features")
    trained = contrastive.fit_contrastive(
        rows, ["label"], dim=16, hidden=(32, 16), epochs=4, lr=1e-2, margin=MARGIN
    )
    out = contrastive.embed(rows.select("row_id", "label", "features"), trained.weights, 16)
    fell = trained.losses[-1] < trained.losses[0]
    return out.groupBy("label").agg(
        F.count("embedding").alias("n"), F.max(F.size("embedding")).alias("dim"), F.lit(fell).alias("loss_fell")
    )


FIT_CONTRASTIVE = """SELECT label, count(*) AS n, 16::integer AS dim, true AS loss_fell FROM embeddings GROUP BY label"""


def random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded order key behind samples, batches and splits."""
    return t.readings(spark, sf_dir).select("ingest_id", shuffled_number("ingest_id", 42).alias("order_key"))


RANDOM_NUMBERS = f"""WITH {t.READINGS}
SELECT ingest_id, ('0x' || substr(md5('42:' || ingest_id::varchar), 1, 15))::bigint AS order_key FROM readings"""

QUERIES = {
    "distinct_values": (distinct_values, DISTINCT_VALUES),
    "distinct_activities": (distinct_activities, DISTINCT_ACTIVITIES),
    "dataset_stats": (dataset_stats, DATASET_STATS),
    "sensor_profile": (sensor_profile, SENSOR_PROFILE),
    "template_stats": (template_stats, TEMPLATE_STATS),
    "head_rows": (head_rows, HEAD_ROWS),
    "sample_per_node": (sample_per_node, SAMPLE_PER_NODE),
    "sample_bottom_k": (sample_bottom_k, SAMPLE_PER_NODE),
    "split_holdout": (split_holdout, SPLIT_HOLDOUT),
    "inject_anomalies": (inject_anomalies, INJECT_ANOMALIES),
    "append_scaled_last": (append_scaled_last, APPEND_SCALED_LAST),
    "wide_features": (wide_features, WIDE_FEATURES),
    "reading_features": (reading_features, READING_FEATURES),
    "tile_vectors": (tile_vectors, TILE_VECTORS),
    "fit_vectors": (fit_vectors, FIT_VECTORS),
    "assemble_vectors": (assemble_vectors, ASSEMBLE_VECTORS),
    "label_buckets": (label_buckets, LABEL_BUCKETS),
    "random_numbers": (random_numbers, RANDOM_NUMBERS),
    "assign_batches": (assign_batches, ASSIGN_BATCHES),
    "contrastive_loss": (contrastive_loss, CONTRASTIVE_LOSS),
    "contrastive_loss_labels": (contrastive_loss_labels, CONTRASTIVE_LOSS_LABELS),
    "fit_contrastive": (fit_contrastive, FIT_CONTRASTIVE),
}
