"""Cleaning, coding, locating and slicing of reading tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.constants import (
    HOUSEKEEPING_SENSORS,
    PARAMETER_CODES,
    PARAMETER_NAMES,
    READING_TIME,
    SUBSYSTEM_CODES,
    SUBSYSTEM_NAMES,
    WIDE_ID_COLUMNS,
)
from gaugewatch.functions.columns import (
    doy_timestamp,
    epoch_seconds,
    month_number,
    parse_values,
    recode,
    sensor_group,
    shorten_node_id,
)
from gaugewatch.operators.scale import dimension_join, rank_in_groups

SENSOR_KEYS = ["subsystem", "sensor", "parameter"]
YEAR_ONE = -62135596800


def drop_sensors(
    df: DataFrame, deny: Iterable[str] = HOUSEKEEPING_SENSORS, keep_null_sensor: bool = True
) -> DataFrame:
    keep = ~F.col("sensor").isin(list(deny))
    return df.filter(F.coalesce(keep, F.lit(keep_null_sensor)))


def shorten_codes(
    df: DataFrame,
    subsystems: dict[str, str] = SUBSYSTEM_CODES,
    parameters: dict[str, str] = PARAMETER_CODES,
) -> DataFrame:
    return df.withColumns(
        {
            "subsystem": recode("subsystem", subsystems),
            "parameter": recode("parameter", parameters),
            "node_id": shorten_node_id("node_id"),
        }
    )


def normalise_readings(
    df: DataFrame,
    subsystems: dict[str, str] = SUBSYSTEM_NAMES,
    parameters: dict[str, str] = PARAMETER_NAMES,
) -> DataFrame:
    """``value_hrf`` becomes ``value``, a saved row index goes, codes are written out."""
    df = df.withColumnRenamed("value_hrf", "value").drop("Unnamed: 0", "_c0")
    return df.withColumns(
        {"subsystem": recode("subsystem", subsystems), "parameter": recode("parameter", parameters)}
    )


def with_epoch(df: DataFrame, zone: str = "UTC") -> DataFrame:
    return df.withColumn("unix_time", epoch_seconds("timestamp", zone))


def prune_values(df: DataFrame) -> DataFrame:
    """Drop the raw counts and every row without a physical value."""
    return df.drop("value_raw").na.drop(subset=["value_hrf"])


def backfill_counts(df: DataFrame, count_params: Iterable[str]) -> DataFrame:
    """Take the raw count as value for parameters that are counts."""
    raw = F.when(F.col("parameter").isin(list(count_params)), F.col("value_raw"))
    return df.withColumn("value_hrf", F.coalesce("value_hrf", raw))


def with_ingest_id(df: DataFrame) -> DataFrame:
    """Ids that grow with the position in the input; sort by them only at a sink."""
    return df.withColumn("ingest_id", F.monotonically_increasing_id())


def in_ingest_order(df: DataFrame) -> DataFrame:
    """Dense positions in ingest order, without a global sort in one task."""
    return rank_in_groups(df, [], ["ingest_id"]).drop("group_size")


def with_values(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn("values", parse_values(column))


def reject_unparsed(df: DataFrame, column: str = "value") -> DataFrame:
    """Keep rows whose value is a number or a list of numbers."""
    return with_values(df, column).filter(F.size("values") > 0)


def numeric_columns(df: DataFrame, id_cols: Iterable[str] = WIDE_ID_COLUMNS) -> list[str]:
    skip = set(id_cols)
    return [
        f.name for f in df.schema.fields
        if f.name not in skip and isinstance(f.dataType, T.NumericType)
    ]


def sparse_samples(df: DataFrame, cols: list[str] | None = None, name: str = "readings") -> DataFrame:
    """Numeric columns as one map without its NULLs, in column order."""
    cols = cols or numeric_columns(df)
    full = F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols])
    )
    return df.withColumn(name, F.map_filter(full, lambda _, v: v.isNotNull() & ~F.isnan(v)))


def default_timestamp(df: DataFrame, ts: str, column: str = "timestamp") -> DataFrame:
    """Fill a missing time with the run's time, given by the caller."""
    given = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.coalesce(given, F.lit(ts)))


def column_roles(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Sort column names into ids, values, timestamps and labels.

    ``id`` must be a word of its own (``node_id``, ``hostID``, ``uuid``), so
    that ``humidity`` is no id. ``overrides`` maps a column to its role.
    """
    roles: dict[str, list[str]] = {"ids": [], "values": [], "timestamps": [], "labels": []}
    for c in df.columns:
        low = c.lower()
        if overrides and c in overrides:
            role = overrides[c]
        elif re.search(r"(^|_)id(_|$)|uuid", low) or re.search(r"[a-z]ID$|^ID$", c):
            role = "ids"
        elif "value" in low:
            role = "values"
        elif "timestamp" in low or "date" in low:
            role = "timestamps"
        else:
            role = "labels"
        roles[role].append(c)
    return roles


def role_arrays(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Add one array of texts per role; label codes are written out by ``names``."""
    names = names or {**SUBSYSTEM_NAMES, **PARAMETER_NAMES}
    out = {}
    for role, cols in column_roles(df).items():
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in cols]
        if role == "labels":
            texts = [recode(t, names) for t in texts]
        out[role] = F.array(*texts) if texts else F.array().cast("array<string>")
    arrays = df
    for role, value in out.items():
        arrays = arrays.withColumn(f"role_{role}", value)
    return arrays


def describe_readings(df: DataFrame, sensors: DataFrame) -> DataFrame:
    """One sentence about host, device and unit of every reading."""
    known = with_units(df, sensors)
    words = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in [*SENSOR_KEYS, "node_id", "hrf_unit"]}
    # The sentence that city prompts start with.
    text = F.format_string(
        "Host %s with make %s, model %s, and sensor type %s. The units of the sensor that is measured"
        " are %s.  This measurement was at time %s \n\n",
        words["node_id"], words["subsystem"], words["sensor"], words["parameter"], words["hrf_unit"],
        F.coalesce("timestamp", F.lit("")),
    )
    return known.withColumn("reading_text", text)


def column_groups(columns: Iterable[str], rules: dict[str, list[str]], skip: Iterable[str] = ()) -> dict:
    """Sensor groups of a wide schema, without empty ones."""
    groups: dict[str, list[str]] = {g: [] for g in [*rules, "other"]}
    for c in columns:
        if c in set(skip):
            continue
        hit = next((g for g, terms in rules.items() if any(t in c.lower() for t in terms)), "other")
        groups[hit].append(c)
    return {g: cols for g, cols in groups.items() if cols}


def unpivot_readings(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """Wide rows as (ids, name, reading) rows without NULLs."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(ids, cols, "name", "reading").filter(F.col("reading").isNotNull())


def group_readings(df: DataFrame, rules: dict[str, list[str]], name: str = "name") -> DataFrame:
    return df.withColumn("sensor_group", sensor_group(name, rules))


def parameter_groups(df: DataFrame) -> DataFrame:
    """Readings and times per parameter of one sample set, as counts."""
    return df.groupBy("parameter").agg(
        F.count("value").alias("readings"), F.count("timestamp").alias("times")
    )


def select_readings(df: DataFrame, **equal: object) -> DataFrame:
    """Rows equal to every given value; None means no condition."""
    for column, value in equal.items():
        if value is not None and column in df.columns:
            df = df.filter(F.col(column) == F.lit(value))
    return df


# --- joins with dimensions ----------------------------------------------------


def locate_readings(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return dimension_join(df, nodes.select("node_id", "lat", "lon"), ["node_id"])


def with_units(df: DataFrame, sensors: DataFrame) -> DataFrame:
    return dimension_join(df, sensors.select(*SENSOR_KEYS, "hrf_unit"), SENSOR_KEYS)


def flag_range(df: DataFrame, sensors: DataFrame, column: str = "value") -> DataFrame:
    """Join the possible range of a sensor and mark values outside it."""
    known = dimension_join(df, sensors.select(*SENSOR_KEYS, "hrf_minval", "hrf_maxval"), SENSOR_KEYS)
    value = F.col(column).try_cast("double")
    inside = value.between(F.col("hrf_minval"), F.col("hrf_maxval"))
    return known.withColumn("out_of_range", ~inside)


# --- time slices --------------------------------------------------------------


def half_month_slices(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Two slices per month from ``first`` to ``last`` (yyyy-MM), with exclusive ends."""
    months = spark.sql(
        f"SELECT explode(sequence(DATE'{first}-01', DATE'{last}-01', INTERVAL 1 MONTH)) AS month"
    )
    middle = F.date_add("month", 15)
    end = F.add_months("month", 1)

    def title(start: Column, until: Column) -> Column:
        days = F.concat_ws("-", F.date_format(start, "dd"), F.date_format(F.date_sub(until, 1), "dd"))
        return F.concat(F.upper(F.date_format("month", "yyyyMMM")), days)

    halves = F.array(
        F.struct(title(F.col("month"), middle).alias("title"), F.col("month").alias("s"), middle.alias("e")),
        F.struct(title(middle, end).alias("title"), middle.alias("s"), end.alias("e")),
    )
    half = months.select(F.explode(halves).alias("half")).select("half.*")
    return half.select(
        "title",
        F.date_format("s", READING_TIME).alias("time_start"),
        F.date_format("e", READING_TIME).alias("time_end"),
    )


def _clamped(c: str) -> Column:
    """A time text whose day is moved back to the month's end where it lies beyond."""
    month = F.concat(F.substring(c, 1, 8), F.lit("01"))
    last = F.dayofmonth(F.last_day(F.to_date(F.try_to_timestamp(month, F.lit("yyyy/MM/dd")))))
    day = F.least(F.substring(c, 9, 2).try_cast("int"), last)
    return F.concat(F.substring(c, 1, 8), F.lpad(day.cast("string"), 2, "0"), F.substring(c, 11, 9))


def slice_by_time(df: DataFrame, slices: DataFrame, inclusive: bool = False) -> DataFrame:
    """Readings with the title of every slice they fall into.

    Slices are listed once per month they touch, which turns the range join
    into an equi join on the month plus a filter.
    """
    bounds = slices.select(
        "title",
        epoch_seconds(_clamped("time_start")).alias("_start"),
        epoch_seconds(_clamped("time_end")).alias("_end"),
    )
    months = F.sequence(month_number("_start"), month_number("_end"))
    listed = bounds.withColumn("_month", F.explode(months))
    timed = df if "unix_time" in df.columns else with_epoch(df)
    # A missing time becomes the year 1, which no slice covers. Join keys that cannot be
    # NULL spare Spark a filter that would work the time out once more.
    keyed = timed.withColumn("_at", F.coalesce("unix_time", F.lit(YEAR_ONE)))
    keyed = keyed.withColumn("_month", F.coalesce(month_number("_at"), F.lit(0)))
    met = dimension_join(keyed, listed, ["_month"], "inner")
    before_end = F.col("_at") <= F.col("_end") if inclusive else F.col("_at") < F.col("_end")
    return met.filter((F.col("_at") >= F.col("_start")) & before_end).drop("_at", "_month", "_start", "_end")


# --- weather --------------------------------------------------------------------


def weather_union(*years: DataFrame) -> DataFrame:
    """Yearly weather tables as one, with a real timestamp."""
    both = years[0]
    for more in years[1:]:
        both = both.unionByName(more)
    return both.withColumn("date", doy_timestamp("Year", "DOY", "UTC"))


def overlay_series(**series: DataFrame) -> DataFrame:
    """Tables with (ts, value) stacked under their names on one time axis."""
    parts = [df.select(F.lit(name).alias("series"), "ts", "value") for name, df in series.items()]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both
