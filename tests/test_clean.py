"""Cleaning on literal rows: bad values, missing names, time zones, slices."""

import pytest
from pyspark.sql import functions as F

from gaugewatch.constants import HOUSEKEEPING_SENSORS, LOADER_GROUPS
from gaugewatch.functions import columns as c
from gaugewatch.operators import clean, features, profiling, sampling


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


@pytest.mark.parametrize(
    "text, values",
    [
        ("1.5", [1.5]), (" 7 ", [7.0]), ("1, 2.5,,3e2", [1.0, 2.5, 300.0]), ("1,x", None),
        ("overflow", None), ("", None), (",", []), (None, None),
    ],
)
def test_parse_values(spark, text, values):
    assert one(spark, text, c.parse_values("x")) == values


@pytest.mark.parametrize("zone, seconds", [("UTC", 1704067200), ("America/Chicago", 1704088800)])
def test_epoch_does_not_depend_on_the_session_zone(spark, zone, seconds):
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert one(spark, "2024/01/01 00:00:00", c.epoch_seconds("x", zone)) == seconds
        assert one(spark, "2018/09/31 00:00:00", c.epoch_seconds("x", zone)) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("2024/11/03 00:30:00", 1730611800), ("2024/11/03 01:30:00", 1730619000), ("2024/11/03 02:30:00", 1730622600),
        ("2024/03/10 01:30:00", 1710055800), ("2024/03/10 02:30:00", 1710059400), ("2024/07/01 12:00:00", 1719853200),
    ],
)
def test_clock_changes(spark, text, seconds):
    """The doubled hour counts as winter time; a time in the skipped hour moves on."""
    assert one(spark, text, c.epoch_seconds("x", "America/Chicago")) == seconds


def test_seconds_since(spark):
    assert one(spark, "2025/07/01 00:00:00", c.seconds_since("x")) == 181 * 86400 - 3600
    assert one(spark, "2020/02/01 00:00:01", c.seconds_since("x", None)) == 31 * 86400 + 1


def test_day_of_year(spark):
    df = spark.createDataFrame([(2018.0, 37.0, 605.0)], "y double, d double, t double")
    assert str(df.select(c.doy_timestamp("y", "d", "t")).first()[0]) == "2018-02-06 06:05:00"


@pytest.mark.parametrize(
    "x, digits, text",
    [(0.00015, 4, "0.0001"), (-2.5, 1, "-2.5"), (9.99996, 4, "10.0000"), (None, 4, None), (12.0, 2, "12.00")],
)
def test_fixed_text(spark, x, digits, text):
    assert one(spark, x, c.fixed_text("x", digits), "double") == text


def test_deny_list_and_missing_sensor(spark):
    df = spark.createDataFrame([("mem",), ("bmp180",), (None,)], "sensor string")
    assert len(HOUSEKEEPING_SENSORS) == 28
    assert clean.drop_sensors(df).count() == 2
    assert clean.drop_sensors(df, keep_null_sensor=False).count() == 1


def test_code_maps_keep_unknown_values(spark):
    row = ("001e0610e532", "chemsense", "x", "pressure", "1")
    df = spark.createDataFrame([row], "node_id string, subsystem string, sensor string, parameter string, value_hrf string")
    short = clean.shorten_codes(df)
    assert short.select("node_id", "subsystem", "parameter").first() == ("0e532", "cs", "pres")
    long = clean.normalise_readings(short.withColumn("Unnamed: 0", F.lit(1)))
    assert long.columns == ["node_id", "subsystem", "sensor", "parameter", "value"]
    assert long.select("subsystem", "parameter").first() == ("chemsense", "pressure")


def test_roles_take_id_as_a_word(spark):
    df = spark.createDataFrame([], "node_id string, hostID string, uuid string, humidity string, value double, timestamp string")
    assert clean.column_roles(df) == {
        "ids": ["node_id", "hostID", "uuid"], "values": ["value"], "timestamps": ["timestamp"], "labels": ["humidity"],
    }
    assert "humidity" in clean.column_roles(df, {"humidity": "values"})["values"]


def test_groups_take_the_first_rule():
    groups = clean.column_groups(["acc_gyro", "lat", "sound", "foo"], LOADER_GROUPS, skip=["foo"])
    assert groups == {"accelerometer": ["acc_gyro"], "location": ["lat"], "audio": ["sound"]}


def test_slices_are_half_open_and_clamped(spark):
    halves = clean.half_month_slices(spark, "2020-02", "2020-02").collect()
    assert [tuple(h) for h in halves] == [
        ("2020FEB01-15", "2020/02/01 00:00:00", "2020/02/16 00:00:00"),
        ("2020FEB16-29", "2020/02/16 00:00:00", "2020/03/01 00:00:00"),
    ]
    times = ["2018/09/30 23:59:59", "2018/10/01 00:00:00", None, "bad"]
    df = spark.createDataFrame([(t,) for t in times], "timestamp string")
    given = spark.createDataFrame([("SEP", "2018/09/16 00:00:00", "2018/09/31 23:59:59")], "title string, time_start string, time_end string")
    assert [r.timestamp for r in clean.slice_by_time(df, given, inclusive=True).collect()] == times[:1]
    assert clean.slice_by_time(df, given).count() == 0


def test_sparse_samples_and_features(spark):
    df = spark.createDataFrame(
        [("u", 2.0, None, 1), ("v", None, float("nan"), 5)], "uuid string, b double, a double, c int"
    )
    got = {r.uuid: r.readings for r in clean.sparse_samples(df).collect()}
    assert got == {"u": {"b": 2.0, "c": 1.0}, "v": {"c": 5.0}}
    assert features.wide_features(df.filter("uuid = 'u'")).first().features == [2.0, 1.0]
    bare = spark.createDataFrame([("u",)], "uuid string")
    assert features.wide_features(bare).first().features == [0.0] * 10


def test_dataset_stats_of_an_empty_table(spark):
    df = spark.createDataFrame([], "node_id string, value double")
    row = profiling.dataset_stats(df, ["node_id"]).first()
    assert (row.total_samples, row.columns, row.missing_values, row.missing_percentage) == (0, 2, 0, 0.0)


def test_profile_falls_back_to_the_first_text(spark):
    rows = [(2, "s", "n", "p", "x", "1"), (1, "s", "n", "p", "3", "2"), (3, "s", "m", "p", "4", "1"), (4, "s", "m", "p", "6", "1")]
    df = spark.createDataFrame(rows, "ingest_id int, subsystem string, sensor string, parameter string, value_hrf string, value_raw string")
    got = {r.sensor: r for r in profiling.sensor_profile(df).collect()}
    assert got["n"].textual and got["n"].first_value == "3" and got["n"].mean_value is None
    assert (got["m"].min_value, got["m"].max_value, got["m"].mean_value, got["m"].std_value) == (4.0, 6.0, 5.0, 1.0)


def test_profile_of_numbers_runs_hashed(spark):
    df = spark.range(20).selectExpr(
        "id as ingest_id", "'s' as subsystem", "'n' as sensor", "'p' as parameter",
        "cast(id as string) as value_hrf", "'1' as value_raw",
    )
    keys = [f.name for f in df.schema.fields if f.name in clean.SENSOR_KEYS]
    plan = df.groupBy(*keys).agg(F.min(F.col("value_hrf").try_cast("double")))._jdf.queryExecution()
    assert "SortAggregate" not in plan.executedPlan().toString()
    row = profiling.sensor_profile(df).first()
    assert (row.min_value, row.max_value, row.mean_value, row.textual, row.first_value) == (0.0, 19.0, 9.5, False, None)


def test_sampling_returns_what_there_is(spark):
    df = spark.range(5).select(F.lit("n").alias("node_id"), F.col("id").alias("ingest_id"))
    assert sampling.sample_per_node(df, 50).count() == 5
    a = {r.ingest_id for r in sampling.sample_per_node(df, 2).collect()}
    assert a == {r.ingest_id for r in sampling.sample_per_node(df.repartition(3), 2).collect()}


def test_holdout_and_injection(spark):
    df = spark.range(25).select(F.lit("n").alias("node_id"), F.col("id").alias("ingest_id"), F.array(F.lit(10.0)).alias("values"))
    held = sampling.inject_anomalies(sampling.split_holdout(df))
    got = {r.ingest_id: r["values"][0] for r in held.filter("is_holdout").collect()}
    assert got == {23: 25.0, 24: 4.0}
    assert held.filter("not is_holdout and values[0] = 10.0").count() == 23
    added = sampling.append_scaled_last(df).filter("is_added").collect()
    assert [(r.ingest_id, r["values"]) for r in added] == [(24, [30.0])]


@pytest.mark.parametrize(
    "n, target, mode, size", [(100, 64, "any", 50), (100, 64, "larger", 100), (100, 7, "smaller", 5), (13, 64, "any", 13)]
)
def test_closest_divisor(n, target, mode, size):
    assert features.closest_divisor(n, target, mode) == size


def test_closest_divisor_limits():
    assert features.closest_divisor(10, 64, "larger") is None
    with pytest.raises(ValueError):
        features.closest_divisor(0, 4)
    with pytest.raises(ValueError):
        features.closest_divisor(4, 4, "near")
