"""The driver tables in the roles of readings, dimensions, wide rows and patterns.

Each view exists twice: as a DataFrame and as the SQL (a named CTE) that the
oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.constants import READING_TIME
from gaugewatch.functions.columns import fixed_text, label_bucket

# One row per event type: subsystem, sensor, parameter, unit, least and greatest possible value.
SENSOR_ROWS = {
    "click": ("metsense", "bmp180", "temperature", "C", -40.0, 125.0),
    "view": ("alphasense", "opc_n2", "bins", "counts", 0.0, 10000.0),
    "purchase": ("chemsense", "lps25h", "pressure", "hPa", 26.0, 126.0),
    "signup": ("metsense", "htu21d", "humidity", "%", 0.0, 100.0),
    "error": ("wagman", "wagman_uptime", "uptime", "s", 0.0, 1.0e9),
}
WIDE_SENSORS = [
    "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "lat_step", "battery",
]
WIDE_DIM = 16
EMBEDDING_THRESHOLD = 1.3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- long readings ------------------------------------------------------------------


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    text = F.col("value").cast("string")

    def pick(place: int) -> Column:
        chain = None
        for kind, row in SENSOR_ROWS.items():
            hit = F.col("event_type") == kind
            chain = F.when(hit, row[place]) if chain is None else chain.when(hit, row[place])
        return chain

    lost_name = (F.col("event_type") == "error") & (k.cast("int") < 10)
    return e.select(
        F.col("event_id").alias("ingest_id"),
        F.date_format("ts", READING_TIME).alias("timestamp"),
        F.concat(F.lit("001e061"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("node_id"),
        pick(0).alias("subsystem"),
        F.when(~lost_name, pick(1)).alias("sensor"),
        pick(2).alias("parameter"),
        k.alias("value_raw"),
        F.when(F.col("value") < 2, F.lit(None).cast("string"))
        .when(F.col("event_type") == "view", F.concat_ws(", ", text, k))
        .when(F.col("value") >= 200, "overflow")
        .otherwise(text)
        .alias("value_hrf"),
    )


def _sql_pick(place: int) -> str:
    whens = " ".join(f"WHEN '{kind}' THEN '{row[place]}'" for kind, row in SENSOR_ROWS.items())
    return f"CASE event_type {whens} END"


READINGS = f"""readings AS (
  SELECT event_id AS ingest_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS timestamp,
         '001e061' || lpad(user_id::varchar, 5, '0') AS node_id,
         {_sql_pick(0)} AS subsystem,
         CASE WHEN NOT (event_type = 'error' AND json_extract_string(props, '$.k')::int < 10)
              THEN {_sql_pick(1)} END AS sensor,
         {_sql_pick(2)} AS parameter,
         json_extract_string(props, '$.k') AS value_raw,
         CASE WHEN value < 2 THEN NULL
              WHEN event_type = 'view' THEN value::varchar || ', ' || json_extract_string(props, '$.k')
              WHEN value >= 200 THEN 'overflow'
              ELSE value::varchar END AS value_hrf
  FROM events)"""

# Readings with the values written out as numbers; no usable value leaves the list NULL.
PARSED = (
    READINGS
    + """,
parsed AS (
  SELECT *, CASE WHEN value_hrf IS NOT NULL AND len(list_filter(parts, lambda p: p IS NULL)) = 0
                 THEN parts END AS vals
  FROM (SELECT *, list_transform(string_split(value_hrf, ','), lambda p: try_cast(trim(p) AS double)) AS parts,
               epoch(strptime(timestamp, '%Y/%m/%d %H:%M:%S'))::bigint AS unix_time
        FROM readings))"""
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit are located nodes; the others have no entry."""
    c = read(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
    n = read(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("001e061"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("node_id"),
        F.concat(F.lit("41."), F.col("n_nationkey").cast("string")).alias("lat"),
        F.concat(F.lit("-87."), F.col("n_regionkey").cast("string")).alias("lon"),
    )


NODES = """nodes AS (
  SELECT '001e061' || lpad(c_custkey::varchar, 5, '0') AS node_id,
         '41.' || n_nationkey::varchar AS lat, '-87.' || n_regionkey::varchar AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0)"""


def sensors(spark: SparkSession) -> DataFrame:
    schema = """subsystem string, sensor string, parameter string, hrf_unit string,
                hrf_minval double, hrf_maxval double"""
    return spark.createDataFrame(list(SENSOR_ROWS.values()), schema)


SENSORS = "sensors(subsystem, sensor, parameter, hrf_unit, hrf_minval, hrf_maxval) AS (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', '{d}', {lo}::double, {hi}::double)" for a, b, c, d, lo, hi in SENSOR_ROWS.values()
) + ")"


# --- wide rows -------------------------------------------------------------------------


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per order; orders without a returned line have no ``mag_x``."""
    item = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("acc_x"),
        (F.max("l_extendedprice") / 1000).alias("acc_y"),
        F.max("l_discount").alias("acc_z"),
        F.min("l_quantity").alias("gyro_x"),
        F.max("l_tax").alias("gyro_y"),
        F.count(F.lit(1)).cast("double").alias("gyro_z"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("mag_x"),
        (F.max("l_tax") - F.min("l_tax")).alias("lat_step"),
        F.min("l_discount").alias("battery"),
    )
    o = read(spark, sf_dir, "orders")
    return o.join(item, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("hostID"),
        F.col("o_orderpriority").alias("activity"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("o_orderkey").alias("uuid"),
        F.col("o_orderstatus").alias("status"),
        *WIDE_SENSORS,
    )


WIDE = """wide AS (
  SELECT 'c' || o_custkey::varchar AS hostID, o_orderpriority AS activity,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp, o_orderkey AS uuid, o_orderstatus AS status,
         acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z, mag_x, lat_step, battery
  FROM orders JOIN (
    SELECT l_orderkey, max(l_quantity) AS acc_x, max(l_extendedprice) / 1000 AS acc_y, max(l_discount) AS acc_z,
           min(l_quantity) AS gyro_x, max(l_tax) AS gyro_y, count(*)::double AS gyro_z,
           max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS mag_x,
           max(l_tax) - min(l_tax) AS lat_step, min(l_discount) AS battery
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""

# The same rows with features (sorted by name, NULL left out) and the tiled embedding.
WIDE_EMBEDDED = (
    WIDE
    + f""",
features AS (
  SELECT *, list_filter([acc_x, acc_y, acc_z, battery, gyro_x, gyro_y, gyro_z, lat_step, mag_x],
                        lambda v: v IS NOT NULL) AS features FROM wide),
embedded AS (
  SELECT *, list_transform(range(0, {WIDE_DIM}), lambda i: features[(i % len(features)) + 1]) AS embedding
  FROM features)"""
)


# --- embeddings as patterns and queries -----------------------------------------------------


def vector_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a pattern; labels 8 and 9 are two kinds of known anomalies."""
    e = read(spark, sf_dir, "embeddings")
    bad = F.col("label") >= 8
    names = F.array(*[F.lit(n) for n in WIDE_SENSORS[:6]])
    values = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double"))
    return e.select(
        F.col("vec_id").alias("pattern_id"),
        "embedding",
        F.concat(F.lit("h"), label_bucket("vec_id").cast("string")).alias("host_id"),
        F.concat(F.lit("a"), F.col("label").cast("string")).alias("activity"),
        F.lit("").alias("ts"),
        bad.alias("is_anomaly"),
        F.when(F.col("label") == 8, "behavioral").when(F.col("label") == 9, "technical").alias("anomaly_type"),
        F.when(~bad, "Normal sensor pattern").alias("description"),
        F.when(bad, F.concat(F.lit("Known deviation of kind "), F.col("label").cast("string"))).alias("explanation"),
        F.map_from_arrays(names, values).alias("readings"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query; searches leave out the vector itself."""
    p = vector_patterns(spark, sf_dir)
    return p.select(
        F.col("pattern_id").alias("query_id"), "embedding", "host_id", "activity", "ts", "readings"
    )


VECTORS = """vectors AS (
  SELECT vec_id, embedding, 'h' || (('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint % 100)::varchar AS host_id,
         'a' || label::varchar AS activity, label, label >= 8 AS is_anomaly,
         CASE label WHEN 8 THEN 'behavioral' WHEN 9 THEN 'technical' END AS anomaly_type,
         CASE WHEN label < 8 THEN 'Normal sensor pattern' END AS description,
         CASE WHEN label >= 8 THEN 'Known deviation of kind ' || label::varchar END AS explanation,
         list_transform(embedding[1:6], lambda v: v::double) AS vals
  FROM embeddings)"""

PAIRS = (
    VECTORS
    + """,
pairs AS MATERIALIZED (
  SELECT a.vec_id AS query_id, b.vec_id AS pattern_id, a.host_id AS own_host, b.host_id, a.activity AS own_activity,
         b.activity, b.is_anomaly, b.anomaly_type, b.description, b.explanation,
         list_sum(list_transform(list_zip(a.embedding, b.embedding),
                  lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) AS distance
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id)"""
)

# The five nearest patterns of any host.
TOP5 = (
    PAIRS
    + """,
hits AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS rank FROM pairs)
  WHERE rank <= 5)"""
)

# Own host first, other hosts from the general five where there are fewer than two.
HOST_FIRST = (
    PAIRS
    + """,
own AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS r
                 FROM pairs WHERE host_id = own_host) WHERE r <= 5),
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS r FROM pairs)
  WHERE r <= 5),
filled AS (
  SELECT *, 0 AS general FROM own
  UNION ALL
  SELECT *, 1 AS general FROM near
  WHERE host_id <> own_host AND query_id NOT IN (SELECT query_id FROM own GROUP BY query_id HAVING count(*) >= 2)),
hits AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY general, distance, pattern_id) AS rank
                 FROM filled) WHERE rank <= 5)"""
)


# --- model answers --------------------------------------------------------------------------------


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per event and prompt kind, of a shape by event type; events go round the vectors they are about."""
    e = read(spark, sf_dir, "events")
    v = vector_queries(spark, sf_dir).select(F.col("query_id").alias("vec_id"), "readings")
    about = F.col("event_id") % F.lit(v.count())
    k = F.get_json_object("props", "$.k")
    verdict = F.when(F.col("value") > 20, "true").otherwise("false")
    told = F.concat(
        F.lit("The acc_x value of "), fixed_text(F.abs("readings.acc_x"), 4),
        F.lit(" and gyro_y differ from the usual "), fixed_text("value", 2),
        F.lit(" of a typical similar pattern"),
    )
    full = F.concat(
        F.lit('{"is_anomaly": '), verdict, F.lit(', "confidence": '), fixed_text(k.cast("double") / 100, 2),
        F.lit(', "explanation": "'), told,
        F.lit('", "user_friendly_message": "Movement looks unusual.", "notable_deviations": '
              '["acc_x is high", "gyro_y is low"], "recommended_actions": ["Check the mount"]}'),
    )
    quoted = F.concat(
        F.lit('{"is_anomaly": '), verdict, F.lit(', "confidence": "0.75", "explanation": "'), told, F.lit('"}')
    )
    short = F.concat(
        F.lit('{"is_anomaly": '), verdict, F.lit(', "explanation": "'), told,
        F.lit('", "notable_deviations": "acc_x", "recommended_actions": ""}'),
    )
    plain = F.when(k.cast("int") < 50, F.concat(F.lit("This is an Anomaly: "), told)).otherwise("All is well.")
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", full).when(kind == "view", quoted).when(kind == "purchase", short)
        .when(kind == "signup", plain)
    )
    both = F.explode(F.array(F.lit("contextual"), F.lit("explanation"))).alias("prompt_kind")
    told_of = e.join(v, about == F.col("vec_id"))
    return told_of.select(F.col("event_id").alias("query_id"), "vec_id", "readings", both, answer.alias("answer"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector and prompt kind the answer of the latest of all events about it."""
    latest = event_answers(spark, sf_dir).groupBy("vec_id", "prompt_kind").agg(F.max_by("answer", "query_id").alias("answer"))
    return latest.withColumnRenamed("vec_id", "query_id")


def fmt(x: str, digits: int) -> str:
    """SQL for a number with fixed decimals, by the rule of ``fixed_text``."""
    scale = 10**digits
    s = f"floor(abs({x}) * {scale} + 0.5)::bigint"
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || ({s} // {scale})::varchar || '.' ||"
        f" lpad(({s} % {scale})::varchar, {digits}, '0'))"
    )


_TOLD = (
    f"'The acc_x value of ' || {fmt('abs(vals[1])', 4)} || ' and gyro_y differ from the usual ' ||"
    f" {fmt('value', 2)} || ' of a typical similar pattern'"
)
EVENT_ANSWERS = f"""about AS (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS about_id FROM events),
told AS (
  SELECT event_id AS query_id, vec_id, vals, event_type, value, json_extract_string(props, '$.k') AS k, {_TOLD} AS told,
         CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS verdict
  FROM vectors JOIN about ON vec_id = about_id),
answers AS MATERIALIZED (
  SELECT query_id, vec_id, vals, CASE event_type
    WHEN 'click' THEN '{{"is_anomaly": ' || verdict || ', "confidence": ' || {fmt('(k::double / 100)', 2)} ||
      ', "explanation": "' || told || '", "user_friendly_message": "Movement looks unusual.", "notable_deviations": ' ||
      '["acc_x is high", "gyro_y is low"], "recommended_actions": ["Check the mount"]}}'
    WHEN 'view' THEN '{{"is_anomaly": ' || verdict || ', "confidence": "0.75", "explanation": "' || told || '"}}'
    WHEN 'purchase' THEN '{{"is_anomaly": ' || verdict || ', "explanation": "' || told ||
      '", "notable_deviations": "acc_x", "recommended_actions": ""}}'
    WHEN 'signup' THEN CASE WHEN k::int < 50 THEN 'This is an Anomaly: ' || told ELSE 'All is well.' END
    END AS answer
  FROM told)"""
_LATEST = "(PARTITION BY vec_id ORDER BY query_id DESC)"
ANSWERS = f"""{EVENT_ANSWERS.replace("answers AS MATERIALIZED", "every_answer AS MATERIALIZED")},
answers AS MATERIALIZED (
  SELECT vec_id AS query_id, vals, answer FROM (SELECT *, row_number() OVER {_LATEST} AS turn FROM every_answer) WHERE turn = 1)"""


def r(x: str, digits: int = 6) -> str:
    """SQL for a rounded double without a negative zero."""
    return f"(round({x}, {digits}) + 0.0)"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT and doubles rounded, as the oracle gives them."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif kind in ("double", "float"):
            out.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
