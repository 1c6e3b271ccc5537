"""Scans and sinks for reading tables."""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.session import cut

RAW_COLUMNS = ["timestamp", "node_id", "subsystem", "sensor", "parameter", "value_raw", "value_hrf"]
NODE_COLUMNS = ["node_id", "lat", "lon"]
TASK_BYTES = 128 << 20  # of small files that one task writes
SENSOR_COLUMNS = ["subsystem", "sensor", "parameter", "hrf_unit", "hrf_minval", "hrf_maxval", "datasheet"]


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of the files that a reader of ``path`` would take; nothing is opened."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def first_lines(files: DataFrame) -> DataFrame:
    """(path, header) of files, opened by the tasks; NULL where the workers' own file systems cannot open one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([first_line(n) for n in names], pa.string())], ["path", "header"]
            )

    return files.select("path").mapInArrow(run, "path string, header string")


def first_line(name: str) -> str | None:
    """The first line of a file by its full name; packed files by their endings."""
    try:
        if name.startswith("file:"):
            system, at = LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
        else:
            system, at = FileSystem.from_uri(quote(name, safe=":/@"))
        with system.open_input_stream(at, compression="detect") as stream:
            held = b""
            while b"\n" not in held and (part := stream.read(1 << 14)):
                held += part
    except (OSError, ValueError, ImportError):
        return None
    return held.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace")


def _driver_first_line(spark: SparkSession, name: str) -> str:
    """The same by the driver's Hadoop client: the way left where tasks have no client of their own."""
    hadoop, io = spark._jvm.org.apache.hadoop, spark._jvm.java.io
    conf = spark._jsc.hadoopConfiguration()
    file = hadoop.fs.Path(name)
    stream = file.getFileSystem(conf).open(file)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    lines = io.BufferedReader(io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return lines.readLine() or ""
    finally:
        lines.close()


def _by_header(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files under ``path`` by their first line; the names are only listed where there are several.

    Spark itself takes the header of one file and applies it to all others by
    position. Files are opened by tasks, so the driver's work does not grow
    with their number.
    """
    told = cut(first_lines(list_files(spark, path)))
    headers = [r["header"] for r in told.select("header").distinct().collect()]
    if len(headers) == 1 and headers[0]:
        return {headers[0]: []}
    found: dict[str, list[str]] = {}
    for row in told.collect():
        header = _driver_first_line(spark, row["path"]) if row["header"] is None else row["header"]
        found.setdefault(header, []).append(row["path"])
    found.pop("", None)
    return found


def read_by_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files as strings, each under its own header; a column that a file lacks is NULL."""
    files = _by_header(spark, path)
    if not files:
        return spark.read.option("header", True).csv(path)
    # A file name may hold what Spark takes for a pattern, so one header reads the path as given.
    groups = [path] if len(files) == 1 else [sorted(names) for _, names in sorted(files.items())]
    parts = [spark.read.option("header", True).csv(names) for names in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _csv_texts(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Read the named columns as strings, whatever their order in each file."""
    df = read_by_header(spark, path)
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw or pruned reading files; a column a file lacks is NULL."""
    return _csv_texts(spark, path, RAW_COLUMNS)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _csv_texts(spark, path, NODE_COLUMNS)


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    df = _csv_texts(spark, path, SENSOR_COLUMNS)
    for bound in ("hrf_minval", "hrf_maxval"):
        df = df.withColumn(bound, F.col(bound).try_cast("double"))
    return df


def read_wide(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Wide sensor rows. Give a schema for large files: inference reads them twice.

    A schema's columns are taken by name from each file; one that a file lacks
    is NULL, and a value that does not parse is too. A missing path gives a
    warning and an empty table.
    """
    try:
        if schema is None:
            return spark.read.option("header", True).option("inferSchema", True).csv(path)
        texts = read_by_header(spark, path)
        return texts.select(
            *[
                (F.col(f.name).try_cast(f.dataType) if f.name in texts.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in schema.fields
            ]
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        warnings.warn(f"no sensor file at {path}", stacklevel=2)
        empty = schema or T.StructType(
            [T.StructField(c, T.StringType()) for c in ("hostID", "activity", "timestamp", "uuid")]
        )
        return spark.createDataFrame([], empty)


def read_weather(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """One table per yearly file; ``weather_union`` puts them together."""
    return [spark.read.option("header", True).csv(p) for p in paths]


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """Time slices from a JSON list of title, time_start, time_end."""
    schema = "title string, time_start string, time_end string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_slices(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per slice title, in one pass.

    The rebalance hint lets Spark split a slice that holds most rows over
    several writers and gather small ones.
    """
    df.hint("rebalance", F.col("title")).write.mode(mode).partitionBy("title").parquet(path)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end: it leaves a marker file there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_bounded(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Files of at most ``rows_per_file`` rows.

    A rerun leaves finished output alone and replaces what a failed run left.
    """
    if not is_finished(df.sparkSession, path):
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("header", True).csv(path)


def split_files(
    spark: SparkSession,
    source: str | list[str],
    path: str,
    transform: Callable[[DataFrame], DataFrame],
    rows_per_file: int,
    wave_bytes: int = 1 << 40,
    max_waves: int | None = None,
) -> int:
    """``transform`` of all source files, in files of bounded rows; a rerun only does what is missing.

    Source files are taken in waves of about ``wave_bytes``, each a job of its
    own. A ledger beside the output names the files of finished waves. A wave
    is named by its files, so one that was written but not entered is replaced
    by its rerun, and finished ones are never touched. Returns the waves done.
    """
    ledger = f"{path}/_ledger"
    files = list_files(spark, source)
    if is_finished(spark, ledger):
        files = files.join(spark.read.schema("path string, wave string").parquet(ledger).select("path"), "path", "left_anti")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # File names and sizes only: as many rows as files are left.
    waiting = cut(files.withColumn("number", F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / F.lit(wave_bytes))))
    numbers = [r["number"] for r in waiting.select("number").distinct().orderBy("number").collect()][:max_waves]
    for number in numbers:
        names = [r["path"] for r in waiting.filter(F.col("number") == number).orderBy("path").collect()]
        wave = hashlib.sha256("\n".join(names).encode()).hexdigest()[:16]
        part = transform(read_by_header(spark, names))
        part.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("header", True).csv(f"{path}/wave={wave}")
        done = waiting.filter(F.col("number") == number).select("path", F.lit(wave).alias("wave"))
        done.coalesce(1).write.mode("append").parquet(ledger)
    return len(numbers)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Total size of a folder, from file metadata only."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(hadoop).getLength()


def compact(
    spark: SparkSession,
    src: str,
    dst: str,
    max_bytes: int = 10_000_000_000,
    order: tuple[str, ...] = ("timestamp", "node_id", "sensor", "parameter"),
) -> None:
    """Gather many small files into time-ordered ones of about ``max_bytes``.

    The range covers more than the time, so rows of one busy second can be
    split. Finished output is left alone, unfinished output replaced.
    """
    if is_finished(spark, dst):
        return
    files = max(1, math.ceil(stored_bytes(spark, src) / max_bytes))
    df = read_by_header(spark, src)
    keys = [c for c in order if c in df.columns]
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option(
        "header", True
    ).csv(dst)


def compact_by_bytes(
    spark: SparkSession,
    source: str | list[str],
    path: str,
    max_bytes: int = 1 << 30,
    order: tuple[str, ...] = ("timestamp", "node_id", "sensor", "parameter"),
    ranges: int = 256,
) -> None:
    """Gather files into Parquet files of about ``max_bytes`` each, ordered by time over all of them.

    Rows are dealt into ranges of the whole order first; running sums of their
    bytes inside of a range, and the sums of the ranges before, say which file
    a row goes to. So borders lie where the bytes are, however uneven times and
    row sizes may be, and a file is at most a row larger than the others. How
    much Parquet packs the rows is measured on the ranges. Finished output is
    left alone.
    """
    if is_finished(spark, path):
        return
    df = read_by_header(spark, source)
    keys = [c for c in order if c in df.columns]
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 1 for c in df.columns), F.lit(0)).cast("bigint")
    # Rows that are equal in the order are told apart by all they hold, equal rows by their place.
    marked = df.withColumns({"_bytes": size, "_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), "_place": F.monotonically_increasing_id()})
    ties = [*keys, "_tie", "_place"]
    held = cut(marked.repartitionByRange(ranges, *ties).withColumn("_range", F.spark_partition_id()))
    told = held.groupBy("_range").agg(F.sum("_bytes").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(told.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))))  # a row per range
    total = offsets.agg(F.sum("_sum")).first()[0]
    if not total:
        df.write.mode("overwrite").parquet(path)
        return
    stored = sum(stored_bytes(spark, f) for f in {r["f"] for r in _folders(held).collect()})
    files = max(1, math.ceil(stored / max_bytes))
    inside = Window.partitionBy("_range").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("_run", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(
        F.broadcast(offsets.select("_range", "_offset")), "_range"
    )
    number = F.least(F.floor((F.col("_offset") + F.col("_run")) / F.lit(total) * F.lit(files)), F.lit(files - 1)).cast("int")
    # Small files share a task, which writes them one after the other; a file lies in one task as a whole.
    each = max(1, min(files // (4 * ranges), TASK_BYTES // max_bytes))
    tasks = math.ceil(files / each)
    dealt = placed.withColumn("file", number).withColumn("_task", F.floor(F.col("file") / F.lit(each)))
    out = dealt.repartition(tasks, "_task").sortWithinPartitions("file", *ties)
    out.select(*df.columns, "file").write.mode("overwrite").partitionBy("file").parquet(path)


def _folders(df: DataFrame) -> DataFrame:
    """The folder that a written table lies in, as one row."""
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("f")).limit(1)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
