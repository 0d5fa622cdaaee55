"""The streamed hourly counts equal the batch counts, also when files come in parts."""

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import load
from jobtrail.streaming import (
    collect_counts, finish_load_stream, late_rows, load as stream_load, run_available, run_load_stream, stream_loads,
)


def test_two_runs_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    cut = events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    # The later half comes first: rows of the second run are late by days.
    for part in (F.col("ts") > cut, F.col("ts") <= cut):
        events.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        run_available(stream, out, state)
    want = events.groupBy(F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, collect_counts(spark, out).collect())) == sorted(map(tuple, want.collect()))


def jobs_of(spark, n=300, seed=6):
    rng = random.Random(seed)
    rows = [(i, rng.choice([100, rng.randint(0, 400)]), rng.choice([1, 40, 300]), rng.randint(0, 3), rng.choice([None, 2])) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, arrival_us long, runtime_us long, gpu_demand long, num_cpu int")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (1, 0, 3, 2)])
def test_load_stream_equals_batch_in_any_order(spark, tmp_path, order):
    jobs, source, out = jobs_of(spark), str(tmp_path / "in"), str(tmp_path / "out")
    for part in order:
        jobs.where(F.floor(F.col("arrival_us") / 101) == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobs.schema).parquet(source)
        run_load_stream(stream, out, str(tmp_path / "offsets"), 400)
    # Until the watermark has passed them jobs wait.
    assert stream_loads(spark, out).count() < jobs.count()
    finish_load_stream(jobs, out)
    assert rows(stream_loads(spark, out)) == rows(load.offered_load(jobs)) and late_rows(spark, out).count() == 0


def test_late_rows_are_set_aside(spark, tmp_path):
    jobs, out = jobs_of(spark), str(tmp_path)
    early, after = jobs.where("arrival_us < 150"), jobs.where("arrival_us >= 150")
    early, lost = early.where("job_id % 5 > 0"), early.where("job_id % 5 = 0")
    nothing = jobs.limit(1).withColumn("arrival_us", F.lit(None).cast("long"))
    for i, batch in enumerate([early, after, lost.unionByName(nothing), jobs.limit(0)]):
        stream_load.add_batch(batch, i, out, 50)
        # A batch repeated after a failure changes nothing.
        stream_load.add_batch(batch, i, out, 50)
    finish_load_stream(jobs, out)
    latest = after.agg(F.max("arrival_us")).first()[0]
    late = lost.where(F.col("arrival_us") < latest - 50)
    assert late_rows(spark, out).count() == late.count() + 1 > 1
    kept = jobs.join(late.select("job_id"), "job_id", "left_anti").select(*jobs.columns)
    assert rows(stream_loads(spark, out)) == rows(load.offered_load(kept))
