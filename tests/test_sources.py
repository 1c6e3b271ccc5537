"""Files in and out."""

import gzip
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch import session
from gaugewatch.operators import clean, feedback, patterns, retrieval
from gaugewatch.sources import readings as src
from gaugewatch.sources import store
from gaugewatch.streaming import score


def test_readings_by_name_whatever_the_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        ",timestamp,node_id,sensor,subsystem,parameter,value_hrf\n0,2018/01/01 00:00:06,001e0610ba46,tmp,metsense,temperature,3.5\n"
    )
    row = src.read_readings(spark, str(tmp_path / "r.csv")).first()
    assert (row.sensor, row.subsystem, row.value_raw, row.value_hrf) == ("tmp", "metsense", None, "3.5")


def test_wide_rows_and_missing_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("hostID,activity,acc_x\nu,walking,1.5\nu,resting,\n")
    wide = src.read_wide(spark, str(tmp_path / "w.csv"))
    assert dict(wide.dtypes)["acc_x"] == "double"
    with pytest.warns(UserWarning):
        assert src.read_wide(spark, str(tmp_path / "none.csv")).count() == 0


def test_slices_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"title": "A", "time_start": "2018/01/01 00:00:00", "time_end": "2018/01/02 00:00:00"}]))
    assert src.read_slices(spark, str(tmp_path / "s.json")).first().title == "A"


def test_bounded_files_are_not_written_twice(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as string) as timestamp", "'n' as node_id")
    small, big = str(tmp_path / "small"), str(tmp_path / "big")
    src.write_bounded(df.repartition(4), small, 10)
    before = sorted(p.name for p in (tmp_path / "small").glob("*.csv"))
    src.write_bounded(df, small, 10)
    assert sorted(p.name for p in (tmp_path / "small").glob("*.csv")) == before and len(before) >= 10
    src.compact(spark, small, big, max_bytes=10**9)
    assert len(list((tmp_path / "big").glob("*.csv"))) == 1
    assert spark.read.option("header", True).csv(big).count() == 100


def test_feedback_log_from_json_and_back(spark, tmp_path):
    entry = {
        "feedback_id": "f1", "timestamp": "2024-01-01T00:00:00", "sample": {"host_id": "u", "readings": {"acc_x": 0.1}},
        "detection": {"is_anomaly": True, "confidence": 0.8},
        "user_feedback": {"correct": False, "actual_anomaly": False, "notes": "my normal walk"}, "processed": False,
    }
    (tmp_path / "log.json").write_text(json.dumps([entry]))
    (tmp_path / "bad.json").write_text('[{"feedback_id": ')
    log = store.import_feedback(spark, str(tmp_path / "log.json"))
    assert store.import_feedback(spark, str(tmp_path / "bad.json")).count() == 0
    path = str(tmp_path / "table")
    assert store.read_feedback(spark, path).count() == 0
    store.append_feedback(log, path)
    stats = feedback.feedback_stats(store.read_feedback(spark, path)).first()
    assert (stats.false_positives, stats.false_positive_rate, stats.accuracy) == (1, 100.0, 0.0)
    made = feedback.process_feedback(log, spark.createDataFrame([], "feedback_id string"))
    row = made.patterns.first()
    assert (row.is_anomaly, row.description) == (False, "my normal walk")
    assert made.counts.first() == (1, 1, 0)
    again = feedback.process_feedback(log, made.ledger)
    assert again.counts.first() == (0, 0, 0)
    copy = store.clear_feedback(spark, path, "20240101")
    assert store.read_feedback(spark, path).count() == 0 and store.read_feedback(spark, copy).count() == 1


def test_stats_of_an_empty_log(spark):
    stats = feedback.feedback_stats(spark.createDataFrame([], store.FEEDBACK_SCHEMA)).first()
    assert (stats.total_feedback_entries, stats.accuracy) == (0, 0.0)


def test_pattern_ids_go_on(spark, tmp_path):
    path = str(tmp_path / "patterns")
    rows = spark.range(3).select(
        F.col("id").alias("n"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"),
        F.lit("u").alias("host_id"), F.lit(None).cast("string").alias("activity"), F.lit(None).cast("string").alias("ts"),
        F.create_map(F.lit("a"), F.lit(1.0)).alias("readings"),
    )
    first = patterns.add_patterns(store.load_patterns(spark, path), patterns.normal_patterns(rows), 2, "n")
    store.save_patterns(first, path)
    more = patterns.add_patterns(store.load_patterns(spark, path), patterns.anomaly_patterns(rows, "t", "e"), 2, "n")
    store.save_patterns(more, path)
    known = store.load_patterns(spark, path).orderBy("pattern_id").collect()
    assert [r.pattern_id for r in known] == list(range(6))
    assert (known[0].activity, known[0].ts, known[5].anomaly_type) == ("unknown", "", "t")
    with pytest.raises(Exception, match="embedding size differs"):
        patterns.add_patterns(store.load_patterns(spark, path), patterns.normal_patterns(rows), 5, "n").collect()


class Named:
    """Stands in for a session: its settings and its master."""

    def __init__(self, master, **settings):
        self.conf = SimpleNamespace(get=lambda key, default: settings.get(key, default))
        self.sparkContext = SimpleNamespace(master=master)


def test_work_folder_is_the_named_one():
    cluster = Named("yarn", **{"spark.checkpoint.dir": "hdfs://shared/"})
    assert session.fresh_path(cluster, "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Named("yarn"))
    assert session.work_folder(Named("local[2]")) == session.work_folder(Named("local[2]"))


def test_stream_scores_like_batch(spark, tmp_path):
    lines = ["timestamp,node_id,subsystem,sensor,parameter,value_raw,value_hrf"]
    lines += [f"2024/01/01 00:00:0{i},n{i % 2},metsense,bmp180,temperature,1,{i}.5" for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines + lines[1:2]) + "\n")

    def to_samples(df):
        return clean.reject_unparsed(df, "value_hrf").select(
            F.xxhash64("node_id", "timestamp").alias("query_id"), F.col("values").alias("embedding"),
            F.col("node_id").alias("host_id"), F.col("parameter").alias("activity"), F.col("timestamp").alias("ts"),
            F.create_map(F.lit("value"), F.get("values", F.lit(0))).alias("readings"),
        )

    known = spark.createDataFrame(
        [(0, [0.5], "n0", "temperature", "", False, None, "normal", None, {"value": 0.5})], store.PATTERN_SCHEMA
    )
    out = str(tmp_path / "out")
    stream = score.stream_readings(spark, str(tmp_path / "in"))
    score.score_stream(stream, to_samples, lambda: known, out, str(tmp_path / "cp")).awaitTermination(120)
    verdicts = spark.read.parquet(out)
    assert verdicts.count() == 7
    assert verdicts.filter(~F.col("is_anomaly")).count() == 2
    assert retrieval.retrieve(to_samples(src.read_readings(spark, str(tmp_path / "in"))), known).count() == 7


def test_stream_leaves_out_named_repeats(spark, tmp_path):
    header = "timestamp,node_id,subsystem,sensor,parameter,value_raw,value_hrf"
    row = "2024/01/01 00:00:00,n0,{},bmp180,temperature,1,{}"
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [row.format("metsense", 1), row.format("metsense", 1), row.format("lightsense", 1), row.format("metsense", 2)]
    late = row.replace("2024", "2020").format("metsense", 1)
    (folder / "a.csv").write_text("\n".join([header, *rows]) + "\n")
    (folder / "b.csv").write_text("\n".join([header, late]) + "\n")
    counts = {}
    for name, unique in (("all", None), ("unique", src.RAW_COLUMNS)):
        stream = score.stream_readings(spark, str(folder), max_files=1, unique=unique)
        out = str(tmp_path / name)
        query = stream.writeStream.format("parquet").option("checkpointLocation", out + "-cp").trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        counts[name] = spark.read.parquet(out).count()
    assert counts == {"all": 5, "unique": 4}


def test_wide_schema_goes_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hostID,acc_x,acc_y\nh1,1,2\n")
    (tmp_path / "b.csv").write_text("acc_y,hostID\n3,h2\n")
    got = src.read_wide(spark, str(tmp_path), T.StructType.fromDDL("hostID string, acc_x double, acc_y double"))
    assert sorted(map(tuple, got.collect())) == [("h1", 1.0, 2.0), ("h2", None, 3.0)]


def test_headers_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """Whatever the number of files, the driver opens none of them."""
    folder = tmp_path / "many files"
    folder.mkdir()
    for i in range(400):
        names = ("timestamp", "node_id", "value_hrf") if i % 4 else ("value_hrf", "timestamp", "sensor", "node_id")
        values = {"timestamp": "2018/01/01 00:00:00", "node_id": f"n{i}", "value_hrf": str(i), "sensor": "s"}
        (folder / f"part {i}.csv").write_text(",".join(names) + "\r\n" * (i % 2) + "\n" * (1 - i % 2) + ",".join(values[n] for n in names) + "\n")
    (folder / "empty.csv").write_text("")
    with gzip.open(folder / "packed.csv.gz", "wt") as file:
        file.write("node_id,value_hrf\nn1000,7\n")

    def opened(*_):
        raise AssertionError("the driver opened a file")

    monkeypatch.setattr(src, "_driver_first_line", opened)
    got = {r.node_id: (r.value_hrf, r.sensor) for r in src.read_readings(spark, str(folder)).collect()}
    assert len(got) == 401 and got["n1000"] == ("7", None)
    assert all(got[f"n{i}"] == (str(i), None if i % 4 else "s") for i in range(400))


def test_files_that_tasks_cannot_open_are_left_to_the_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("node_id,value_hrf\nn1,1\n")
    (tmp_path / "b.csv").write_text("value_hrf,node_id\n2,n2\n")
    unknown = lambda files: files.select("path", F.lit(None).cast("string").alias("header"))
    monkeypatch.setattr(src, "first_lines", unknown)
    assert {(r.node_id, r.value_hrf) for r in src.read_readings(spark, str(tmp_path)).collect()} == {("n1", "1"), ("n2", "2")}


def test_split_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    for i in range(8):
        (raw / f"{i}.csv").write_text("node_id,value_hrf\n" + f"n{i},{i}\n" * 50)
    read = lambda: sorted((r.node_id, r.value_hrf) for r in src.read_readings(spark, str(out)).collect())
    state = lambda: {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in out.rglob("*.csv")}
    size = (raw / "0.csv").stat().st_size
    keep = lambda df: df.filter("value_hrf <> '3'")
    assert src.split_files(spark, str(raw), str(out), keep, 20, 2 * size, max_waves=2) == 2
    half = state()
    assert len(read()) == 150 and len(half) >= 9
    # The next wave is written, but its job dies before the ledger knows.
    real = DataFrameWriter.parquet

    def dies(self, path, *args, **options):
        if path.endswith("_ledger"):
            raise RuntimeError("lost")
        return real(self, path, *args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", dies)
        with pytest.raises(RuntimeError, match="lost"):
            src.split_files(spark, str(raw), str(out), keep, 20, 2 * size)
    assert src.split_files(spark, str(raw), str(out), keep, 20, 2 * size) == 2
    assert {k: v for k, v in state().items() if k in half} == half
    assert read() == sorted((f"n{i}", str(i)) for i in range(8) if i != 3 for _ in range(50))
    assert src.split_files(spark, str(raw), str(out), keep, 20, 2 * size) == 0
    (raw / "9.csv").write_text("value_hrf,node_id\n9,n9\n")
    assert src.split_files(spark, str(raw), str(out), keep, 20, 2 * size) == 1 and len(read()) == 351


def test_compacted_files_are_even_in_bytes(spark, tmp_path):
    """One busy second with most rows, and rows of very different sizes."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    draw = random.Random(4)
    lines = []
    for i in range(6000):
        second = "2018/01/01 00:00:07" if i % 4 else f"2018/01/01 00:{i % 60:02}:00"
        lines.append(f"{second},n{i % 3},{draw.getrandbits(4000 if i < 300 else 60):x}")
    (raw / "a.csv").write_text("timestamp,node_id,value_hrf\n" + "\n".join(lines) + "\n")
    src.compact_by_bytes(spark, str(raw), out, 60_000, ranges=8)
    sizes = [r["length"] for r in src.list_files(spark, out + "/*/*.parquet").collect()]
    assert len(sizes) > 4 and max(sizes) <= 1.2 * 60_000 and min(sizes) > 10_000
    back = spark.read.parquet(out)
    assert sorted(f"{r.timestamp},{r.node_id},{r.value_hrf}" for r in back.collect()) == sorted(lines)
    spans = back.groupBy("file").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("file").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))
    src.compact_by_bytes(spark, str(raw), out, 1, ranges=8)  # finished output stays
    assert len(src.list_files(spark, out + "/*/*.parquet").collect()) == len(sizes)


def test_small_files_of_a_compaction_share_tasks(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    rows = spark.range(6000).selectExpr("concat('2024/01/', lpad(cast(id % 28 as string), 2, '0')) as timestamp", "cast(id as string) as node_id")
    rows.write.option("header", True).csv(str(raw))
    src.compact_by_bytes(spark, str(raw), out, 600, ranges=4)
    names = [f.rsplit("/", 1)[1] for f in spark.read.parquet(out).inputFiles()]
    tasks = {n.split("-")[1] for n in names}
    assert len(names) > 64 and len(tasks) <= 17
    back = spark.read.parquet(out)
    assert back.count() == 6000 and back.groupBy("file").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).count() == len(names)
    ends = back.groupBy("file").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("file").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(ends, ends[1:]))
