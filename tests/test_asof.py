"""As-of joins in all directions and load span by span, against plain loops and whole runs."""

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import asof, daily_load, load, scan


def small_blocks(monkeypatch, rows):
    for name in ("GROUP_ROWS", "WHOLE_ROWS", "MOST_ROWS"):
        monkeypatch.setattr(scan, name, rows)


def partner(row, right, direction, tolerance):
    group, at = row[1], row[2]
    if at is None:
        return (None, None)
    own = [(r[1], r[2]) for r in right if r[0] == group and r[1] is not None]
    back = max((r for r in own if r[0] <= at), key=lambda r: (r[0], r[1]), default=None)
    ahead = min((r for r in own if r[0] >= at), key=lambda r: (r[0], r[1]), default=None)
    found = {"backward": back, "forward": ahead}.get(direction)
    if direction == "nearest":
        found = min((r for r in (back, ahead) if r), key=lambda r: (abs(r[0] - at), r[0] > at), default=None)
    if found is None or (tolerance is not None and abs(found[0] - at) > tolerance):
        return (None, None)
    return (found[1], found[0])


@pytest.mark.parametrize("block_rows", [6, 1 << 20])
@pytest.mark.parametrize("direction,tolerance", [("backward", None), ("forward", 3), ("nearest", None), ("nearest", 0)])
def test_against_loops(spark, monkeypatch, direction, tolerance, block_rows):
    small_blocks(monkeypatch, block_rows)
    rng = random.Random(block_rows)
    groups = ["a", "a", "a", "b", None]
    left = [(i, rng.choice(groups), rng.choice([None, 50, rng.randint(0, 100)]), i) for i in range(120)]
    right = [(rng.choice(groups), rng.choice([None, 50, rng.randint(0, 100)]), i, "x") for i in range(60)]
    lf = spark.createDataFrame(left, "id long, g string, t long, _asof0 long").repartition(3)
    rf = spark.createDataFrame(right, "g string, t long, v long, extra string").repartition(2)
    got = asof.asof_join(lf, rf, "t", ["v"], ["g"], direction, tolerance, tie="v", at="found_at")
    assert got.columns == ["id", "g", "t", "_asof0", "v", "found_at"]
    want = {r[0]: partner(r, right, direction, tolerance) for r in left}
    assert {r.id: (r.v, r.found_at) for r in got.collect()} == want


@pytest.mark.parametrize("block_rows", [6, 1 << 20])
@pytest.mark.parametrize("direction", asof.DIRECTIONS)
def test_no_frame_is_gone_through_for_every_row(spark, monkeypatch, direction, block_rows):
    """A frame from a row to the group's end is summed up anew per row, so a group would cost its size squared."""
    small_blocks(monkeypatch, block_rows)
    rows = spark.range(40).selectExpr("id", "id % 2 AS g", "id AS t", "id AS v")
    found = asof.asof_join(rows.select("id", "g", "t"), rows.select("g", "t", "v"), "t", ["v"], ["g"], direction)
    text = found._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in text and "unboundedfollowing" not in text


def test_empty_sides(spark):
    one = spark.createDataFrame([(1, 5)], "id long, t long")
    none = spark.createDataFrame([], "t long, v long")
    assert [tuple(r) for r in asof.asof_join(one, none, "t", ["v"]).collect()] == [(1, 5, None)]
    assert asof.asof_join(one.limit(0), one.withColumnRenamed("id", "v"), "t", ["v"], direction="nearest").count() == 0
    with pytest.raises(ValueError):
        asof.asof_join(one, none, "t", ["v"], direction="sideways")


def trace(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice([100, 200, rng.randint(0, 299)]), rng.choice([1, 30, 250]), rng.randint(0, 3), rng.choice([None, 2, 5])) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, arrival_us long, runtime_us long, gpu_demand long, num_cpu int")


def test_three_spans_equal_the_whole(spark, tmp_path):
    jobs = trace(spark)
    whole = sorted(map(tuple, load.offered_load(jobs).collect()))
    parts, previous = [], None
    for start in (0, 100, 200):
        span = jobs.where((F.col("arrival_us") >= start) & (F.col("arrival_us") < start + 100))
        parts += map(tuple, daily_load.append_span(span, str(tmp_path), start, start + 100, previous).collect())
        previous = start
    assert sorted(parts) == whole
    # The carry is what is still running: its rows add up to an idle cluster in the end.
    carry = spark.read.parquet(f"{tmp_path}/carry/start=200")
    assert tuple(carry.agg(*[F.sum(c) for c in daily_load.DELTAS]).first()) == (0, 0, 0)


def test_a_span_reads_its_jobs_and_the_carry_only(spark, tmp_path):
    jobs = trace(spark)
    for start in (0, 100, 200):
        jobs.where((F.col("arrival_us") >= start) & (F.col("arrival_us") < start + 100)).write.parquet(f"{tmp_path}/jobs/start={start}")
    previous = None
    for start in (0, 100):
        daily_load.append_span(spark.read.parquet(f"{tmp_path}/jobs/start={start}"), f"{tmp_path}/out", start, start + 100, previous)
        previous = start
    carry = spark.read.schema(daily_load.CARRY).parquet(f"{tmp_path}/out/carry/start=100")
    found = daily_load.span_load(spark.read.parquet(f"{tmp_path}/jobs/start=200"), carry, 200, 300)
    assert {f.split("/")[-2] for f in found.inputFiles()} == {"start=200", "start=100"}
    assert not any("start=0/" in f or "jobs/start=100" in f for f in found.inputFiles())


def test_spans_may_be_repeated_empty_or_refused(spark, tmp_path):
    jobs = trace(spark, 50)
    first = jobs.where("arrival_us < 100")
    once = daily_load.append_span(first, str(tmp_path), 0, 100).collect()
    assert sorted(map(tuple, daily_load.append_span(first, str(tmp_path), 0, 100).collect())) == sorted(map(tuple, once))
    assert daily_load.append_span(jobs.limit(0), str(tmp_path), 100, 200, 0).count() == 0
    later = jobs.where("arrival_us >= 200")
    got = daily_load.append_span(later, str(tmp_path), 200, 300, 100).collect()
    whole = load.offered_load(first.unionByName(later)).where("arrival_us >= 200").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))
    with pytest.raises(ValueError, match="do not arrive"):
        daily_load.append_span(jobs, str(tmp_path), 0, 100)


def test_a_span_reads_its_own_files(spark, tmp_path):
    jobs = trace(spark).unionByName(trace(spark, 3).withColumn("arrival_us", F.lit(None).cast("long")))
    table = daily_load.deal_spans(jobs.coalesce(1), str(tmp_path / "jobs"), 100)
    span = table.where(F.col("start") == 100)
    files = [r[0] for r in span.select(F.input_file_name()).distinct().collect()]
    assert len(files) == spark.sparkContext.defaultParallelism and all("start=100/" in f for f in files)
    want = sorted(r.job_id for r in jobs.where("arrival_us BETWEEN 100 AND 199").collect())
    assert sorted(r.job_id for r in span.collect()) == want and table.count() == 400
