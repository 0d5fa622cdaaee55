"""Load at arrival over a stream of jobs, with a watermark and a side table of late rows.

What a micro-batch leaves for the next is a version of three small tables: the
watermark, the jobs waiting for it, and the carry of ``daily_load`` (the load at
the watermark and the ends still to come). A job gets its load once the watermark,
the latest arrival so far less ``delay_us``, has passed it, so the order in which rows come within the
delay does not matter. Rows older than the watermark would change loads already
given out; they go to the side table and count nowhere. Versions are
written by batch number and the watermark last, so a batch repeated after a
failure starts from the version before it and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.operators import daily_load
from jobtrail.operators.scan import FIRST
from jobtrail.sources.traces import _path_exists

STATE = "watermark long"
END = 1 << 62


def _version(spark: SparkSession, folder: str, before: int) -> tuple[int, int | None]:
    """The last complete batch before this one and its watermark."""
    if not _path_exists(spark, f"{folder}/state/batch=*"):
        return -1, None
    row = spark.read.schema(f"{STATE}, batch long").parquet(f"{folder}/state").where(F.col("batch") < before) \
        .agg(F.max_by("watermark", "batch").alias("watermark"), F.max("batch").alias("batch")).first()
    return (-1, None) if row["batch"] is None else (row["batch"], row["watermark"])


def add_batch(batch: DataFrame, batch_id: int, folder: str, delay_us: int, last: bool = False) -> None:
    """Take the jobs of a batch in; ``last`` gives all that wait their load."""
    spark, columns = batch.sparkSession, batch.columns
    previous, mark = _version(spark, folder, batch_id)
    waiting, carry = batch.limit(0), daily_load.no_carry(spark)
    if previous >= 0:
        waiting = spark.read.schema(batch.schema).parquet(f"{folder}/waiting/batch={previous}")
        carry = spark.read.schema(daily_load.CARRY).parquet(f"{folder}/carry/batch={previous}")
    start = FIRST if mark is None else mark
    late = F.col("arrival_us").isNull() | (F.col("arrival_us") < start)
    latest = batch.agg(F.max("arrival_us")).first()[0]
    end = END if last else max(start, start if latest is None else latest - delay_us)
    every = waiting.unionByName(batch.where(~late)).select(*columns)
    ready = every.where(F.col("arrival_us") < end)

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    write(batch.where(late), "late")
    write(daily_load.span_load(ready, carry, start, end), "load")
    write(daily_load.next_carry(ready, carry, start, end), "carry")
    write(every.where(F.col("arrival_us") >= end), "waiting")
    write(spark.createDataFrame([(end,)], STATE), "state")


def run_load_stream(stream: DataFrame, folder: str, checkpoint: str, delay_us: int) -> None:
    """Process what is there batch by batch and stop; jobs younger than the watermark wait for the next run."""
    query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, folder, delay_us)).start())
    query.awaitTermination()


def finish_load_stream(like: DataFrame, folder: str) -> None:
    """Give the jobs that still wait their load, once no more rows will come; ``like`` has the stream's columns."""
    add_batch(like.limit(0), _version(like.sparkSession, folder, END)[0] + 1, folder, 0, last=True)


def stream_loads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/load").drop("batch")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/late")
