"""Block scans equal plain windows, whatever the cut, the skew or the partition count."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from jobtrail.operators import queueing, scan as scans
from jobtrail.operators.quantiles import quantiles
from jobtrail.functions.expressions import double_key
from jobtrail.operators.scan import LEAF_BITS, Scan, key_scan, nested_sum, text_ordinal, with_ordinal


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=[1, 4, 17])
def partitions(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    # Without merging of small partitions the tiny frames really span several blocks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def skewed(spark):
    """Group 0 holds most rows; a third of them share one instant."""
    base = spark.range(600)
    return base.select(
        "id",
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7_000_000)).otherwise(F.col("id") * 7919 % 1000 * 50_021).alias("t"),
        ((F.col("id") * 31) % 17 - 5).alias("v"),
    )


def test_key_scan_matches_window(spark, partitions):
    df = skewed(spark).groupBy("g", "t").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("g").orderBy("t")
    want = df.select("g", "t", "v",
                     F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"),
                     F.lag("v").over(w).alias("p"), F.sum("v").over(Window.partitionBy("g")).alias("n"))
    got = key_scan(df, "t", [Scan("s", "sum", "v"), Scan("m", "max", "v"),
                             Scan("p", "last", "v", before=True), Scan("n", "total", "v")], by=["g"])
    assert rows(got) == rows(want)


def test_key_scan_independent_of_block_width(spark, monkeypatch):
    df = skewed(spark).groupBy("t").agg(F.sum("v").alias("v"))
    outcomes = []
    for leaf, parent in ((2, 3), (10, 4), (16, 8), (22, 20)):
        monkeypatch.setattr(scans, "LEAF_BITS", leaf)
        monkeypatch.setattr(scans, "PARENT_BITS", parent)
        outcomes.append(rows(key_scan(df, "t", [Scan("s", "sum", "v"), Scan("m", "max", "v")])))
    assert all(o == outcomes[0] for o in outcomes)


def test_nested_sum_matches_window(spark, partitions):
    df = skewed(spark)
    upto = Window.partitionBy("g").orderBy("t", "v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(upto).alias("s"))
    assert rows(nested_sum(df, ["t", "v", "id"], "v", ["g"], "s")) == rows(want)


@pytest.mark.parametrize("block_rows", [3, 40, 1 << 20])
def test_nested_sum_in_any_blocks(spark, block_rows, monkeypatch):
    small_blocks(monkeypatch, block_rows)
    df = skewed(spark).withColumn("t", F.when(F.col("id") % 50 != 7, F.col("t")))
    order = [F.asc_nulls_first("t"), "v", "id"]
    upto = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(upto).alias("s"))
    assert rows(nested_sum(df, ["t", "v", "id"], "v", ["g"], "s")) == rows(want)
    whole = df.select("*", F.sum("v").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert rows(nested_sum(df, ["t", "v", "id"], "v", [], "s")) == rows(whole)
    assert nested_sum(df.limit(0), ["t", "v", "id"], "v", ["g"], "s").count() == 0


def small_blocks(monkeypatch, block_rows):
    for name in ("GROUP_ROWS", "WHOLE_ROWS", "MOST_ROWS"):
        monkeypatch.setattr(scans, name, block_rows)


def test_hot_values_are_cut_by_the_next_column(spark, monkeypatch):
    """A third of all rows share group and instant, half of those the second value too; no block gets much of them."""
    small_blocks(monkeypatch, 50)
    df = spark.range(3000).select("id", F.lit("q").alias("g"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("t"),
                                  F.when(F.col("id") % 6 == 0, 9).otherwise(F.col("id") % 11).alias("v"))
    blocked = scans.in_blocks(df, ["g"], ["t", "v", "id"])
    sizes = [r["n"] for r in blocked.rows.groupBy(scans.BLOCK).agg(F.count("*").alias("n")).collect()]
    assert blocked.cut and sum(sizes) == 3000 and max(sizes) <= 200 and len(sizes) >= 30


@pytest.mark.parametrize("block_rows", [1, 7, 1 << 20])
def test_queues_in_any_blocks(spark, block_rows, monkeypatch):
    small_blocks(monkeypatch, block_rows)
    rng = random.Random(block_rows)
    jobs = [(i, rng.choice(["a", "a", "b", None]), rng.choice([5, rng.randint(0, 400)]), rng.randint(0, 9)) for i in range(120)]
    frame = spark.createDataFrame(jobs, "job_id long, queue_id string, arrival_us long, runtime_us long")
    free, want, periods, last = {}, {}, {}, {}
    for job, queue, at, run in sorted(jobs, key=lambda j: (j[2], j[0])):
        opens = queue not in free or at >= free[queue]
        last[queue] = last.get(queue, 0) + opens
        start = max(at, free.get(queue, at))
        free[queue] = start + run
        want[job] = (queue, start, start + run)
        periods.setdefault((queue, last[queue]), []).append(run)
    got = {r.job_id: (r.queue_id, r.start_us, r.completion_us) for r in queueing.queue_fifo(frame).collect()}
    assert got == want
    found = {(r.queue_id, r.period): (r.jobs, r.work_us) for r in queueing.busy_periods(frame).collect()}
    assert found == {k: (len(v), sum(v)) for k, v in periods.items()}


def test_double_keys_keep_order_and_tell_values_apart(spark):
    rng = random.Random(1)
    values = [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0),
              2.0, math.nextafter(2.0, 1), 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), -float("inf"),
              1e300, 4.0, 0.1, -0.1, 3.0]
    values += [rng.uniform(-4, 4) for _ in range(300)] + [math.ldexp(rng.uniform(1, 2), rng.randint(-1060, 1020)) for _ in range(300)]
    values += [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1060, 1024, 7)]
    found = dict(map(tuple, spark.createDataFrame([(v,) for v in values], "x double").select("x", double_key(F.col("x"))).collect()))
    order = sorted(set(values))
    keys = [found[v] for v in order]
    assert all(a < b for a, b in zip(keys, keys[1:]))


def test_many_doubles_in_a_narrow_range_spread_over_blocks(spark):
    df = spark.range(2_000_000).select((F.col("id") * 1.5e-6 + 1.0).alias("x"))
    blocks = df.select(F.shiftright(double_key(F.col("x")), LEAF_BITS).alias("b")).groupBy("b").count()
    assert blocks.agg(F.count("*"), F.max("count")).first()[1] < 100


def test_text_ordinal(spark, partitions):
    df = skewed(spark).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"))
    want = df.select("c", F.row_number().over(Window.orderBy("c")).cast("bigint").alias("n"))
    assert rows(text_ordinal(df, "c", "n")) == rows(want)


def test_ordinal(spark, partitions):
    df = skewed(spark)
    want = df.select("*", F.row_number().over(Window.orderBy("t", "id")).cast("bigint").alias("ordinal"))
    assert rows(with_ordinal(df, ["t", "id"])) == rows(want)


def test_quantiles_match_percentile(spark, partitions):
    df = skewed(spark).withColumn("x", F.col("t") / 977.0 - 3000)
    want = df.groupBy("g").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.95).alias("b"),
                               F.percentile("x", 0.0).alias("lo"), F.percentile("x", 1.0).alias("hi"))
    got = quantiles(df, "x", {"a": 0.5, "b": 0.95, "lo": 0.0, "hi": 1.0}, ["g"])
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b)


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 5, 3), ("a", 1, 4)], "g string, t bigint, v bigint")
    got = rows(key_scan(df, "t", [Scan("s", "sum", "v")], by=["g"]))
    assert got == rows(spark.createDataFrame([(None, 1, 2, 2), (None, 5, 3, 5), ("a", 1, 4, 4)],
                                             "g string, t bigint, v bigint, s bigint"))
