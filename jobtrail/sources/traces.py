"""Reading raw traces and reading or writing engineered job tables."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.util import inheritable_thread_target

from jobtrail.schema import RAW_TRACE


# First lines read at the same time.
HEADERS_AT_ONCE = 32


@dataclass(frozen=True)
class TracePaths:
    """Where the tables of one installation lie."""

    main: str
    baseline: str | None = None
    processed: str | None = None
    time_format: str | None = None


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def _require_path(spark: SparkSession, path: str, hint: str = "") -> None:
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"No data found at {path}.{hint}")


def _csv_files(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """The CSV files below a path or pattern with the names in their first line, of which many are read at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    files, waiting = [], list(fs.globStatus(place))
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            waiting += list(fs.listStatus(status.getPath()))
        elif status.getLen() and not status.getPath().getName().startswith(("_", ".")):
            files.append(status.getPath())

    def with_header(file) -> tuple[str, tuple[str, ...]]:
        stream, codec = fs.open(file), codecs.getCodec(file)
        stream = stream if codec is None else codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = (reader.readLine() or "").removeprefix("\ufeff")
        reader.close()
        return file.toString(), tuple(name.strip() for name in next(csv.reader([line]), []))

    with ThreadPool(HEADERS_AT_ONCE) as pool:
        return sorted(pool.map(inheritable_thread_target(spark)(with_header), files))


def _parsed(name: str, dtype: T.DataType, time_format: str | None) -> Column:
    """A text column as its type; text that does not parse ends the job with its value."""
    text = F.trim(F.col(name))
    text = F.when(text != "", text)
    if isinstance(dtype, T.StringType):
        return F.col(name)
    if name == "submit_time" and time_format is not None:
        value = F.try_to_timestamp(text) if time_format == "iso" else F.try_to_timestamp(text, F.lit(time_format))
    elif isinstance(dtype, T.IntegralType):
        # Whole numbers may be written with a fraction of zero, as tools do for columns with gaps.
        value = F.coalesce(text.try_cast(dtype), F.when(text.try_cast("double") % 1 == 0, text.try_cast("double").try_cast(dtype)))
    else:
        value = text.try_cast(dtype)
    bad = F.raise_error(F.concat(F.lit(f"Column {name} holds a value that is no {dtype.simpleString()}: "), text))
    return F.when(text.isNotNull() & value.isNull(), bad.cast(T.NullType())).otherwise(value)


def raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_TRACE, time_format: str | None = None) -> DataFrame:
    """Raw trace from CSV files, each read by its own header.

    Files may order columns differently and omit optional ones. Numbers are
    checked: a value that is none ends the job. ``submit_time`` is a number
    unless ``time_format`` gives the pattern of its text (``iso`` for ISO 8601).
    """
    known = {f.name: f.dataType for f in schema.fields}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, header in _csv_files(spark, path):
        by_header.setdefault(header, []).append(file)
    if not by_header:
        return spark.createDataFrame([], schema)
    frames = []
    for header, files in sorted(by_header.items()):
        texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
        frame = spark.read.schema(texts).option("header", True).csv(files)
        frames.append(frame.select(*[_parsed(n, known.get(n, T.StringType()), time_format).alias(n) for n in header]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def raw_trace(spark: SparkSession, path: str, schema: T.StructType = RAW_TRACE,
              time_format: str | None = None) -> DataFrame:
    """Raw trace from Parquet, or from CSV with headers and an explicit schema (see ``raw_csv``)."""
    _require_path(spark, path)
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return raw_csv(spark, path, schema, time_format)
    return spark.read.parquet(path)


def load_main(spark: SparkSession, paths: TracePaths) -> DataFrame:
    return raw_trace(spark, paths.main, time_format=paths.time_format)


def load_baseline_estimate(spark: SparkSession, paths: TracePaths) -> DataFrame:
    if not paths.baseline:
        raise ValueError("No baseline-estimate trace is configured.")
    return raw_trace(spark, paths.baseline, time_format=paths.time_format)


def load_processed(spark: SparkSession, paths: TracePaths) -> DataFrame:
    if not paths.processed:
        raise ValueError("No processed job table is configured.")
    return read_job_table(spark, paths.processed)


# Dataset keys.
READERS = {"main": load_main, "baseline": load_baseline_estimate, "main_utilization": load_processed}


def load_sample(spark: SparkSession, which: str, paths: TracePaths) -> DataFrame:
    if which not in READERS:
        raise ValueError(f"Unknown dataset: {which!r}; choose one of {sorted(READERS)}.")
    return READERS[which](spark, paths)


# CSV options that keep microseconds, for writing and reading.
CSV_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def write_job_table(df: DataFrame, path: str, fmt: str = "parquet", by_day: bool = False) -> None:
    """Write an engineered table; ``by_day`` partitions it by arrival day for pruning."""
    if by_day:
        day = df.withColumn("arrival_day", F.to_date("arrival_time"))
        # Days are brought together, and a busy day is split by its size.
        writer = day.hint("rebalance", F.col("arrival_day")).write.mode("overwrite").partitionBy("arrival_day")
    else:
        writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, **CSV_TIMES).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unknown format: {fmt!r}")


def read_job_table(spark: SparkSession, path: str) -> DataFrame:
    """Engineered table; Parquet keeps its types, so nothing is restored by hand."""
    _require_path(spark, path, " Prepare and write the job table first.")
    return spark.read.parquet(path)
