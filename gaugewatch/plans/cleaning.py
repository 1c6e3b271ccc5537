"""Queries over scans, cleaning, joins, slices and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.constants import (
    HOUSEKEEPING_SENSORS,
    LOADER_GROUPS,
    PARAMETER_CODES,
    PARAMETER_GROUPS,
    PARAMETER_NAMES,
    SUBSYSTEM_CODES,
    SUBSYSTEM_NAMES,
)
from gaugewatch.functions.columns import epoch_seconds, seconds_since
from gaugewatch.operators import clean
from gaugewatch.plans import tables as t
from gaugewatch.plans.tables import r
from gaugewatch.session import fresh_path
from gaugewatch.sources import readings as src

_DENY = ", ".join(f"'{s}'" for s in HOUSEKEEPING_SENSORS)


def _sql_recode(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items())
    return f"CASE {column} {whens} ELSE {column} END"


def _sql_groups(column: str, rules: dict[str, list[str]]) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{term}')" for term in terms) + f" THEN '{group}'"
        for group, terms in rules.items()
    )
    return f"CASE {whens} ELSE 'other' END"


# --- cleaning ------------------------------------------------------------------------


def drop_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_sensors(t.readings(spark, sf_dir)).select("ingest_id", "node_id", "sensor")


DROP_SENSORS = f"""WITH {t.READINGS}
SELECT ingest_id, node_id, sensor FROM readings WHERE sensor IS NULL OR sensor NOT IN ({_DENY})"""


def drop_sensors_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.drop_sensors(t.readings(spark, sf_dir), keep_null_sensor=False)
    return kept.groupBy("subsystem", "sensor").agg(F.count(F.lit(1)).alias("n"))


DROP_SENSORS_STRICT = f"""WITH {t.READINGS}
SELECT subsystem, sensor, count(*) AS n FROM readings WHERE sensor NOT IN ({_DENY}) GROUP BY ALL"""


def shorten_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.shorten_codes(t.readings(spark, sf_dir)).select("ingest_id", "node_id", "subsystem", "parameter")


SHORTEN_CODES = f"""WITH {t.READINGS}
SELECT ingest_id, replace(node_id, '001e061', '') AS node_id,
       {_sql_recode('subsystem', SUBSYSTEM_CODES)} AS subsystem,
       {_sql_recode('parameter', PARAMETER_CODES)} AS parameter FROM readings"""


def normalise_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = clean.shorten_codes(t.readings(spark, sf_dir))
    return clean.normalise_readings(short).select("ingest_id", "subsystem", "parameter", "value")


NORMALISE_READINGS = f"""WITH {t.READINGS}, short AS (
  SELECT ingest_id, value_hrf, {_sql_recode('subsystem', SUBSYSTEM_CODES)} AS s,
         {_sql_recode('parameter', PARAMETER_CODES)} AS p FROM readings)
SELECT ingest_id, {_sql_recode('s', SUBSYSTEM_NAMES)} AS subsystem,
       {_sql_recode('p', PARAMETER_NAMES)} AS parameter, value_hrf AS value FROM short"""


def reading_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.readings(spark, sf_dir)
    return df.select(
        "ingest_id",
        epoch_seconds("timestamp").alias("utc_seconds"),
        epoch_seconds("timestamp", "America/Chicago").alias("chicago_seconds"),
        seconds_since("timestamp").alias("since_2025"),
        seconds_since("timestamp", None).alias("since_new_year"),
    )


READING_EPOCHS = f"""WITH {t.READINGS}, parsed AS (
  SELECT ingest_id, strptime(timestamp, '%Y/%m/%d %H:%M:%S') AS ts FROM readings)
SELECT ingest_id, epoch(ts)::bigint AS utc_seconds, epoch(timezone('America/Chicago', ts))::bigint AS chicago_seconds,
       (epoch(timezone('America/Chicago', ts)) - epoch(timezone('America/Chicago', timestamp '2025-01-01')))::bigint AS since_2025,
       (epoch(timezone('America/Chicago', ts)) - epoch(timezone('America/Chicago', date_trunc('year', ts))))::bigint AS since_new_year
FROM parsed"""


def prune_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prune_values(t.readings(spark, sf_dir))


PRUNE_VALUES = f"""WITH {t.READINGS}
SELECT ingest_id, timestamp, node_id, subsystem, sensor, parameter, value_hrf FROM readings WHERE value_hrf IS NOT NULL"""


def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.backfill_counts(t.readings(spark, sf_dir), ["bins", "uptime"])
    return filled.select("ingest_id", "parameter", "value_hrf")


BACKFILL_COUNTS = f"""WITH {t.READINGS}
SELECT ingest_id, parameter,
       coalesce(value_hrf, CASE WHEN parameter IN ('bins', 'uptime') THEN value_raw END) AS value_hrf FROM readings"""


def in_ingest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.drop_sensors(t.readings(spark, sf_dir))
    return t.tidy(clean.in_ingest_order(kept).select("ingest_id", "position"))


IN_INGEST_ORDER = f"""WITH {t.READINGS}
SELECT ingest_id, row_number() OVER (ORDER BY ingest_id) - 1 AS position
FROM readings WHERE sensor IS NULL OR sensor NOT IN ({_DENY})"""


def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.with_values(t.readings(spark, sf_dir), "value_hrf")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return t.tidy(
        df.select("ingest_id", F.coalesce(F.size("values"), F.lit(-1)).alias("parts"), total.alias("total"))
    )


PARSE_VALUES = f"""WITH {t.PARSED}
SELECT ingest_id, coalesce(len(vals), -1) AS parts, {r('list_sum(vals)')} AS total FROM parsed"""


def reject_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.reject_unparsed(t.readings(spark, sf_dir), "value_hrf")
    return df.select("ingest_id", "node_id", "value_hrf")


REJECT_UNPARSED = f"""WITH {t.PARSED}
SELECT ingest_id, node_id, value_hrf FROM parsed WHERE len(vals) > 0"""


def sparse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.sparse_samples(t.wide(spark, sf_dir))
    return df.select("uuid", F.explode("readings").alias("name", "reading"))


SPARSE_SAMPLES = f"""WITH {t.WIDE}
SELECT uuid, name, reading FROM (
  UNPIVOT (SELECT uuid, acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z, mag_x, lat_step, battery FROM wide)
  ON acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z, mag_x, lat_step, battery INTO NAME name VALUE reading)"""


def default_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.wide(spark, sf_dir)
    unknown = df.withColumn("timestamp", F.when(F.col("status") == "F", F.col("timestamp")))
    return clean.default_timestamp(unknown, "2024-02-01T00:00:00").select("uuid", "timestamp")


DEFAULT_TIMESTAMP = f"""WITH {t.WIDE}
SELECT uuid, CASE WHEN status = 'F' THEN timestamp ELSE '2024-02-01T00:00:00' END AS timestamp FROM wide"""


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.normalise_readings(t.readings(spark, sf_dir).drop("value_raw"))
    roles = clean.role_arrays(df)
    return roles.select(
        "ingest_id", *[F.array_join(f"role_{n}", "|").alias(n) for n in ("ids", "values", "timestamps", "labels")]
    )


COLUMN_ROLES = f"""WITH {t.READINGS}
SELECT ingest_id, ingest_id::varchar || '|' || node_id AS ids, coalesce(value_hrf, 'unknown') AS values,
       timestamp AS timestamps, subsystem || '|' || coalesce(sensor, 'unknown') || '|' || parameter AS labels
FROM readings"""


def describe_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.describe_readings(t.readings(spark, sf_dir), t.sensors(spark)).select("ingest_id", "reading_text")


DESCRIBE_READINGS = f"""WITH {t.READINGS}, {t.SENSORS}
SELECT ingest_id, 'Host ' || node_id || ' with make ' || r.subsystem || ', model ' || coalesce(r.sensor, 'unknown') ||
       ', and sensor type ' || r.parameter || '. The units of the sensor that is measured are ' ||
       coalesce(hrf_unit, 'unknown') || '.  This measurement was at time ' || timestamp || ' ' || chr(10) || chr(10) AS reading_text
FROM readings r LEFT JOIN sensors s USING (subsystem, sensor, parameter)"""


def group_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = clean.unpivot_readings(t.wide(spark, sf_dir), t.WIDE_SENSORS, ["uuid"])
    grouped = clean.group_readings(long, LOADER_GROUPS)
    return t.tidy(grouped.groupBy("sensor_group").agg(F.count(F.lit(1)).alias("n"), F.max("reading").alias("top")))


GROUP_READINGS = f"""WITH {t.WIDE}, long AS (
  UNPIVOT (SELECT uuid, acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z, mag_x, lat_step, battery FROM wide)
  ON acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z, mag_x, lat_step, battery INTO NAME name VALUE reading)
SELECT {_sql_groups('name', LOADER_GROUPS)} AS sensor_group, count(*) AS n, {r('max(reading)')} AS top
FROM long GROUP BY 1"""


def parameter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parameter_groups(clean.normalise_readings(t.readings(spark, sf_dir)))


PARAMETER_GROUP_SQL = f"""WITH {t.READINGS}
SELECT parameter, count(value_hrf) AS readings, count(timestamp) AS times FROM readings GROUP BY 1"""


def group_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = clean.group_readings(t.readings(spark, sf_dir), PARAMETER_GROUPS, "parameter")
    return grouped.groupBy("sensor_group", "parameter").agg(F.count(F.lit(1)).alias("n"))


GROUP_PARAMETERS = f"""WITH {t.READINGS}
SELECT {_sql_groups('parameter', PARAMETER_GROUPS)} AS sensor_group, parameter, count(*) AS n FROM readings GROUP BY ALL"""


def select_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.readings(spark, sf_dir)
    return clean.select_readings(df, node_id=None, subsystem="metsense", parameter="temperature").select(
        "ingest_id", "node_id", "sensor", "value_hrf"
    )


SELECT_READINGS = f"""WITH {t.READINGS}
SELECT ingest_id, node_id, sensor, value_hrf FROM readings WHERE subsystem = 'metsense' AND parameter = 'temperature'"""


# --- joins --------------------------------------------------------------------------------


def locate_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = clean.locate_readings(t.readings(spark, sf_dir), t.nodes(spark, sf_dir))
    return located.select("ingest_id", "node_id", "lat", "lon", "value_hrf")


LOCATE_READINGS = f"""WITH {t.READINGS}, {t.NODES}
SELECT ingest_id, node_id, lat, lon, value_hrf FROM readings LEFT JOIN nodes USING (node_id)"""


def with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_units(t.readings(spark, sf_dir), t.sensors(spark)).select("ingest_id", "sensor", "hrf_unit")


WITH_UNITS = f"""WITH {t.READINGS}, {t.SENSORS}
SELECT ingest_id, r.sensor, hrf_unit FROM readings r LEFT JOIN sensors s USING (subsystem, sensor, parameter)"""


def flag_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = clean.flag_range(t.readings(spark, sf_dir), t.sensors(spark), "value_hrf")
    verdict = F.coalesce(F.col("out_of_range").cast("string"), F.lit("unknown"))
    return t.tidy(flagged.select("ingest_id", "hrf_minval", "hrf_maxval", verdict.alias("out_of_range")))


FLAG_RANGE = f"""WITH {t.READINGS}, {t.SENSORS}
SELECT ingest_id, hrf_minval, hrf_maxval,
       coalesce((NOT (try_cast(value_hrf AS double) BETWEEN hrf_minval AND hrf_maxval))::varchar, 'unknown') AS out_of_range
FROM readings r LEFT JOIN sensors s USING (subsystem, sensor, parameter)"""


def clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning job: location, deny list, codes, epoch, usable values."""
    located = clean.locate_readings(t.readings(spark, sf_dir), t.nodes(spark, sf_dir))
    kept = clean.prune_values(clean.drop_sensors(located))
    return clean.with_epoch(clean.shorten_codes(kept)).select(
        "ingest_id", "unix_time", "node_id", "subsystem", "sensor", "parameter", "value_hrf", "lat", "lon"
    )


CLEAN_READINGS = f"""WITH {t.READINGS}, {t.NODES}
SELECT ingest_id, epoch(strptime(timestamp, '%Y/%m/%d %H:%M:%S'))::bigint AS unix_time,
       replace(node_id, '001e061', '') AS node_id, {_sql_recode('subsystem', SUBSYSTEM_CODES)} AS subsystem, sensor,
       {_sql_recode('parameter', PARAMETER_CODES)} AS parameter, value_hrf, lat, lon
FROM readings LEFT JOIN nodes USING (node_id)
WHERE (sensor IS NULL OR sensor NOT IN ({_DENY})) AND value_hrf IS NOT NULL"""


# --- slices ----------------------------------------------------------------------------------


def _order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice",
        F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss").alias("timestamp"),
    )


_HALVES = """halves AS (
  SELECT upper(strftime(m, '%Y%b')) || strftime(s, '%d') || '-' || strftime(e - INTERVAL 1 DAY, '%d') AS title, s, e
  FROM (SELECT m, m AS s, m + INTERVAL 15 DAY AS e FROM months
        UNION ALL SELECT m, m + INTERVAL 15 DAY, m + INTERVAL 1 MONTH FROM months))"""


def slice_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = clean.half_month_slices(spark, "2024-01", "2024-01")
    return clean.slice_by_time(t.readings(spark, sf_dir), halves).select("ingest_id", "title", "unix_time")


SLICE_BY_TIME = f"""WITH {t.READINGS}, months AS (SELECT timestamp '2024-01-01' AS m), {_HALVES},
timed AS (SELECT ingest_id, strptime(timestamp, '%Y/%m/%d %H:%M:%S') AS ts FROM readings)
SELECT ingest_id, title, epoch(ts)::bigint AS unix_time FROM timed JOIN halves ON ts >= s AND ts < e"""


def slice_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of seven years cut into 168 half months."""
    halves = clean.half_month_slices(spark, "1995-01", "2001-12")
    cut = clean.slice_by_time(_order_times(spark, sf_dir), halves)
    return t.tidy(cut.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")))


_MONTHS = "months AS (SELECT unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-01', INTERVAL 1 MONTH)) AS m)"
SLICE_MANY = f"""WITH {_MONTHS}, {_HALVES}
SELECT title, count(*) AS n, {r('max(o_totalprice)')} AS top
FROM orders JOIN halves ON o_orderdate >= s AND o_orderdate < e GROUP BY title"""


def slice_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given slices with inclusive ends; a day beyond the month's end is moved back."""
    rows = [
        ("1998AUG16-31", "1998/08/16 00:00:00", "1998/08/31 23:59:59"),
        ("1998SEP16-31", "1998/09/16 00:00:00", "1998/09/31 23:59:59"),
        ("1998SEP-OCT", "1998/09/01 00:00:00", "1998/10/31 00:00:00"),
    ]
    given = spark.createDataFrame(rows, "title string, time_start string, time_end string")
    cut = clean.slice_by_time(_order_times(spark, sf_dir), given, inclusive=True)
    return t.tidy(cut.select("title", "row_id", "unix_time"))


SLICE_INCLUSIVE = """WITH given(title, s, e) AS (VALUES
  ('1998AUG16-31', timestamp '1998-08-16 00:00:00', timestamp '1998-08-31 23:59:59'),
  ('1998SEP16-31', timestamp '1998-09-16 00:00:00', timestamp '1998-09-30 23:59:59'),
  ('1998SEP-OCT', timestamp '1998-09-01 00:00:00', timestamp '1998-10-31 00:00:00'))
SELECT title, o_orderkey AS row_id, epoch(o_orderdate)::bigint AS unix_time
FROM orders JOIN given ON o_orderdate BETWEEN s AND e"""


def _weather(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Event values in the shape of two weather files: year, day of year, hhmm, air temperature."""
    e = t.read(spark, sf_dir, "events")
    shaped = e.select(
        "event_id",
        F.year("ts").cast("double").alias("Year"),
        F.dayofyear("ts").cast("double").alias("DOY"),
        (F.hour("ts") * 100 + F.minute("ts")).cast("double").alias("UTC"),
        F.col("value").alias("AirTemp"),
    )
    early = F.col("DOY") <= 15
    return [shaped.filter(early), shaped.filter(~early)]


def weather_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = clean.weather_union(*_weather(spark, sf_dir))
    return t.tidy(both.select("event_id", F.unix_timestamp("date").alias("epoch"), "AirTemp"))


WEATHER_UNION = f"""SELECT event_id, epoch(date_trunc('minute', ts))::bigint AS epoch, {r('value')} AS AirTemp FROM events"""


def overlay_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = clean.weather_union(*_weather(spark, sf_dir)).select(
        F.unix_timestamp("date").alias("ts"), F.col("AirTemp").alias("value")
    )
    sensor = clean.with_epoch(t.readings(spark, sf_dir)).select(
        F.col("unix_time").alias("ts"), F.col("value_hrf").try_cast("double").alias("value")
    )
    both = clean.overlay_series(sensor=sensor.filter(F.col("value").isNotNull()), weather=weather)
    day = F.floor(F.col("ts") / 86400).alias("day")
    return t.tidy(both.groupBy("series", day).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


OVERLAY_SERIES = f"""WITH {t.READINGS}, both_series AS (
  SELECT 'sensor' AS series, epoch(strptime(timestamp, '%Y/%m/%d %H:%M:%S'))::bigint AS ts, try_cast(value_hrf AS double) AS value
  FROM readings WHERE try_cast(value_hrf AS double) IS NOT NULL
  UNION ALL SELECT 'weather', epoch(date_trunc('minute', ts))::bigint, value FROM events)
SELECT series, ts // 86400 AS day, count(*) AS n, {r('avg(value)')} AS mean FROM both_series GROUP BY ALL"""


# --- scans and sinks: written to the work folder and read again --------------------------------


def scan_raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings, nodes and sensors through CSV files, then joined."""
    where = {n: fresh_path(spark, n) for n in ("raw", "nodes", "sensors")}
    raw = t.readings(spark, sf_dir).drop("ingest_id")
    for name, df in (("raw", raw), ("nodes", t.nodes(spark, sf_dir)), ("sensors", t.sensors(spark))):
        df.write.option("header", True).csv(where[name])
    read = src.read_readings(spark, where["raw"])
    located = clean.locate_readings(read, src.read_nodes(spark, where["nodes"]))
    known = clean.with_units(located, src.read_sensors(spark, where["sensors"]))
    return known.groupBy("subsystem", "sensor", "hrf_unit").agg(
        F.count(F.lit(1)).alias("n"), F.count("lat").alias("located"), F.count("value_hrf").alias("valued")
    )


SCAN_RAW_FILES = f"""WITH {t.READINGS}, {t.NODES}, {t.SENSORS}
SELECT r.subsystem, r.sensor, hrf_unit, count(*) AS n, count(lat) AS located, count(value_hrf) AS valued
FROM readings r LEFT JOIN nodes USING (node_id) LEFT JOIN sensors s USING (subsystem, sensor, parameter) GROUP BY ALL"""


def scan_wide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "wide")
    t.wide(spark, sf_dir).write.option("header", True).csv(path)
    df = src.read_wide(spark, path, t.wide(spark, sf_dir).schema)
    return t.tidy(
        df.groupBy("activity").agg(
            F.count(F.lit(1)).alias("n"), F.count("mag_x").alias("with_mag"), F.max("acc_y").alias("top")
        )
    )


SCAN_WIDE_FILES = f"""WITH {t.WIDE}
SELECT activity, count(*) AS n, count(mag_x) AS with_mag, {r('max(acc_y)')} AS top FROM wide GROUP BY 1"""


def write_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "slices")
    halves = clean.half_month_slices(spark, "1995-01", "2001-12")
    src.write_slices(clean.slice_by_time(_order_times(spark, sf_dir), halves), path)
    back = spark.read.parquet(path)
    return back.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("unix_time").alias("first"))


WRITE_SLICES = f"""WITH {_MONTHS}, {_HALVES}
SELECT title, count(*) AS n, min(epoch(o_orderdate)::bigint) AS first
FROM orders JOIN halves ON o_orderdate >= s AND o_orderdate < e GROUP BY title"""


def write_and_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned readings in many bounded files, then gathered into few ordered ones."""
    small, big = fresh_path(spark, "small"), fresh_path(spark, "big")
    src.write_bounded(clean.prune_values(t.readings(spark, sf_dir)), small, rows_per_file=1000)
    src.write_bounded(clean.prune_values(t.readings(spark, sf_dir)), small, rows_per_file=1000)
    src.compact(spark, small, big, max_bytes=1_000_000)
    back = src.read_readings(spark, big)
    return back.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


WRITE_AND_COMPACT = f"""WITH {t.READINGS}
SELECT node_id, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last
FROM readings WHERE value_hrf IS NOT NULL GROUP BY 1"""



def write_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that a failed run left without its marker is written again, a finished one is not."""
    path = fresh_path(spark, "resumed")
    pruned = clean.prune_values(t.readings(spark, sf_dir))
    pruned.limit(5).write.option("header", True).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").csv(path)
    src.write_bounded(pruned, path, rows_per_file=1000)
    src.write_bounded(pruned.limit(5), path, rows_per_file=1000)
    back = src.read_readings(spark, path)
    return back.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))


WRITE_RESUMED = f"""WITH {t.READINGS}
SELECT sensor, count(*) AS n, min(timestamp) AS first FROM readings WHERE value_hrf IS NOT NULL GROUP BY 1"""


def compact_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned readings, half of them of one second, in files of bounded bytes."""
    small, big = fresh_path(spark, "small"), fresh_path(spark, "big")
    rows = clean.prune_values(t.readings(spark, sf_dir))
    busy = F.when(F.pmod("ingest_id", F.lit(2)) == 0, F.lit("2024/01/09 00:00:00")).otherwise(F.col("timestamp"))
    src.write_bounded(rows.withColumn("timestamp", busy), small, rows_per_file=1000)
    most = 20_000
    src.compact_by_bytes(spark, small, big, most, ranges=16)
    sizes = src.list_files(spark, f"{big}/*/*.parquet").agg(F.max("length").alias("largest"), F.count(F.lit(1)).alias("files")).first()
    # A file of Parquet has some thousand bytes of its own.
    even = sizes["largest"] <= 1.2 * most + 4000
    back = spark.read.parquet(big)
    return back.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.lit(even).alias("even")
    )


COMPACT_BY_BYTES = f"""WITH {t.READINGS}, busy AS (
  SELECT *, CASE WHEN ingest_id % 2 = 0 THEN '2024/01/09 00:00:00' ELSE timestamp END AS moved FROM readings WHERE value_hrf IS NOT NULL)
SELECT node_id, count(*) AS n, min(moved) AS first, max(moved) AS last, true AS even FROM busy GROUP BY 1"""


def split_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files split in waves: a run that ends after the first one, a run for the rest, and one with nothing to do."""
    raw, path = fresh_path(spark, "raw"), fresh_path(spark, "split")
    t.readings(spark, sf_dir).select(*src.RAW_COLUMNS).repartition(6).write.option("header", True).csv(raw)
    wave = max(1, src.stored_bytes(spark, raw) // 3)
    for most in (1, None, None):
        src.split_files(spark, raw, path, clean.prune_values, 1000, wave, most)
    back = src.read_readings(spark, path)
    return back.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))


def scan_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, pruned and reordered files in one folder, each read under its own header."""
    path = fresh_path(spark, "mixed")
    raw = t.readings(spark, sf_dir)
    third = F.pmod("ingest_id", F.lit(3))
    for number, columns in enumerate((src.RAW_COLUMNS, [c for c in src.RAW_COLUMNS if c != "value_raw"], src.RAW_COLUMNS[::-1])):
        raw.where(third == number).select(*columns).write.mode("append").option("header", True).csv(path)
    back = src.read_readings(spark, path)
    return back.groupBy("node_id", "sensor").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_raw").alias("raw"), F.count("value_hrf").alias("valued"),
        F.min("timestamp").alias("first"), F.max("value_hrf").alias("top"),
    )


SCAN_MIXED_FILES = f"""WITH {t.READINGS}
SELECT node_id, sensor, count(*) AS n, count(value_raw) FILTER (WHERE ingest_id % 3 <> 1) AS raw, count(value_hrf) AS valued,
       min(timestamp) AS first, max(value_hrf) AS top
FROM readings GROUP BY ALL"""


def scan_weather_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly weather tables through CSV files, read back and put together."""
    paths = []
    for year in _weather(spark, sf_dir):
        paths.append(fresh_path(spark, "weather"))
        year.write.option("header", True).csv(paths[-1])
    both = clean.weather_union(*src.read_weather(spark, *paths))
    return t.tidy(both.select(F.col("event_id").cast("long").alias("event_id"), F.unix_timestamp("date").alias("epoch"), F.col("AirTemp").cast("double").alias("AirTemp")))


QUERIES = {
    "drop_sensors": (drop_sensors, DROP_SENSORS),
    "drop_sensors_strict": (drop_sensors_strict, DROP_SENSORS_STRICT),
    "shorten_codes": (shorten_codes, SHORTEN_CODES),
    "normalise_readings": (normalise_readings, NORMALISE_READINGS),
    "reading_epochs": (reading_epochs, READING_EPOCHS),
    "prune_values": (prune_values, PRUNE_VALUES),
    "backfill_counts": (backfill_counts, BACKFILL_COUNTS),
    "in_ingest_order": (in_ingest_order, IN_INGEST_ORDER),
    "parse_values": (parse_values, PARSE_VALUES),
    "reject_unparsed": (reject_unparsed, REJECT_UNPARSED),
    "sparse_samples": (sparse_samples, SPARSE_SAMPLES),
    "default_timestamp": (default_timestamp, DEFAULT_TIMESTAMP),
    "column_roles": (column_roles, COLUMN_ROLES),
    "describe_readings": (describe_readings, DESCRIBE_READINGS),
    "group_readings": (group_readings, GROUP_READINGS),
    "parameter_groups": (parameter_groups, PARAMETER_GROUP_SQL),
    "group_parameters": (group_parameters, GROUP_PARAMETERS),
    "select_readings": (select_readings, SELECT_READINGS),
    "locate_readings": (locate_readings, LOCATE_READINGS),
    "with_units": (with_units, WITH_UNITS),
    "flag_range": (flag_range, FLAG_RANGE),
    "clean_readings": (clean_readings, CLEAN_READINGS),
    "slice_by_time": (slice_by_time, SLICE_BY_TIME),
    "slice_many": (slice_many, SLICE_MANY),
    "slice_inclusive": (slice_inclusive, SLICE_INCLUSIVE),
    "weather_union": (weather_union, WEATHER_UNION),
    "overlay_series": (overlay_series, OVERLAY_SERIES),
    "scan_raw_files": (scan_raw_files, SCAN_RAW_FILES),
    "scan_wide_files": (scan_wide_files, SCAN_WIDE_FILES),
    "write_slices": (write_slices, WRITE_SLICES),
    "write_and_compact": (write_and_compact, WRITE_AND_COMPACT),
    "write_resumed": (write_resumed, WRITE_RESUMED),
    "compact_by_bytes": (compact_by_bytes, COMPACT_BY_BYTES),
    "split_resumed": (split_resumed, WRITE_RESUMED),
    "scan_mixed_files": (scan_mixed_files, SCAN_MIXED_FILES),
    "scan_weather_files": (scan_weather_files, WEATHER_UNION),
}
