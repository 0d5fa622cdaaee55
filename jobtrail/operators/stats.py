"""Descriptive statistics of a job table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.functions.expressions import exact_mean, to_seconds
from jobtrail.functions.frames import attach, require_columns
from jobtrail.operators.quantiles import quantiles, value_counts
from jobtrail.operators.scan import Scan, key_scan

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def basic_stats(jobs: DataFrame) -> DataFrame:
    """Size, runtime level and tail, GPU demand and time span of a workload, in one row."""
    require_columns(jobs, ["job_runtime", "gpu_demand", "arrival_time"])
    row = jobs.agg(
        F.count(F.lit(1)).alias("num_jobs"),
        to_seconds(exact_mean(F.col("runtime_us"))).alias("mean_runtime"),
        exact_mean(F.col("gpu_demand")).alias("mean_gpu_demand"),
        F.max("gpu_demand").cast("bigint").alias("max_gpu_demand"),
        ((F.max("arrival_us") - F.min("arrival_us")) / F.lit(3.6e9)).alias("time_span_hours"),
    )
    marks = quantiles(jobs, "runtime_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return attach(row, marks, "_q").select(
        "num_jobs", "mean_runtime",
        to_seconds(F.col("_q.p50")).alias("median_runtime"),
        to_seconds(F.col("_q.p95")).alias("p95_runtime"),
        to_seconds(F.col("_q.p99")).alias("p99_runtime"),
        "mean_gpu_demand", "max_gpu_demand", "time_span_hours")


def workload_summary(jobs: DataFrame) -> DataFrame:
    """``basic_stats`` under the names used in report tables."""
    return basic_stats(jobs).withColumnsRenamed({
        "mean_runtime": "mean_runtime_sec", "median_runtime": "median_runtime_sec",
        "p95_runtime": "p95_runtime_sec", "p99_runtime": "p99_runtime_sec"})


def runtime_tails(jobs: DataFrame) -> DataFrame:
    """Tail marks of the runtime and how far P95 lies above the median."""
    marks = quantiles(jobs, "runtime_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})
    seconds = marks.select(*[to_seconds(F.col(c)).alias(c) for c in marks.columns])
    return seconds.withColumn("p95_p50_ratio", F.try_divide("p95", "p50"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    moments = long.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    marks = quantiles(long, "x", QUARTILES, ["column"])
    return moments.join(marks, "column", "left")


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, in value order."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage of the columns that have nulls, most first; one pass."""
    names = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    long = counts.unpivot(["_rows"], names, "column", "missing")
    return (long.where(F.col("missing") > 0)
            .select("column", "missing", (F.col("missing") * 100.0 / F.col("_rows")).alias("percent"))
            .orderBy(F.desc("missing"), "column"))


def table_info(df: DataFrame) -> DataFrame:
    """Type and non-null count per column."""
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return (counts.unpivot([], df.columns, "column", "non_null")
            .select("column", F.element_at(types, F.col("column")).alias("type"), "non_null"))


def verify_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count, nulls and range of each column of a written table; one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.count_if(F.col(c).isNull()).alias("nulls"),
                 F.min(F.col(c).cast("double")).alias("low"),
                 F.max(F.col(c).cast("double")).alias("high")).alias(c) for c in columns])
    return counts.unpivot(["rows"], list(columns), "column", "_v").select("column", "rows", "_v.*")


def _pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums, products and ranges around the columns' means, of all ordered column pairs.

    Only rows where both columns are present count for a pair. Dozens of pairs
    exceed what one generated aggregation handles well, so each task multiplies
    its batches as matrices and emits one row per pair. The centre is one for
    all tasks, so their sums simply add up, without cancelling large terms.
    """
    names = list(columns)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    centres = values.agg(*[F.avg(c).alias(c) for c in names])
    around = attach(values, centres, "_centre").select(*[(F.col(c) - F.col(f"_centre.{c}")).alias(c) for c in names])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, p = np.zeros((4, len(names), len(names)))
        low, high = np.full((len(names), len(names)), np.inf), np.full((len(names), len(names)), -np.inf)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            there = ~np.isnan(x)
            for j in range(len(names)):
                both = there & there[:, j:j + 1]
                low[:, j] = np.minimum(low[:, j], np.where(both, x, np.inf).min(axis=0, initial=np.inf))
                high[:, j] = np.maximum(high[:, j], np.where(both, x, -np.inf).max(axis=0, initial=-np.inf))
            x, there = np.where(there, x, 0.0), there.astype(float)
            n, s, q, p = n + there.T @ there, s + x.T @ there, q + (x * x).T @ there, p + x.T @ x
        out = {"n": n, "sa": s, "sb": s.T, "qa": q, "qb": q.T, "p": p,
               "la": low, "ha": high, "lb": low.T, "hb": high.T}
        a, b = (i.ravel() for i in np.indices(n.shape))
        yield pd.DataFrame({"a": np.take(names, a), "b": np.take(names, b), **{c: m.ravel() for c, m in out.items()}})

    parts = ["n", "sa", "sb", "qa", "qb", "p", "la", "ha", "lb", "hb"]
    partial = around.mapInPandas(moments, "a string, b string, " + ", ".join(f"{c} double" for c in parts))
    ways = {"l": F.min, "h": F.max}
    return partial.groupBy("a", "b").agg(*[ways.get(c[0], F.sum)(c).alias(c) for c in parts])


def _pearson(moments: DataFrame) -> DataFrame:
    def inner(products: str, left: str, right: str) -> Column:
        return F.col(products) - F.try_divide(F.col(left) * F.col(right), F.col("n"))

    varies = (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))
    spread = F.sqrt(inner("qa", "sa", "sa")) * F.sqrt(inner("qb", "sb", "sb"))
    return moments.select("a", "b", F.when(varies, F.try_divide(inner("p", "sa", "sb"), spread)).alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all ordered pairs, pairwise complete; null for a constant column."""
    return _pearson(_pair_moments(df, columns))


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target, strongest positive first."""
    pairs = _pair_moments(df, [*columns, target]).where((F.col("b") == target) & (F.col("a") != target))
    return _pearson(pairs).select(F.col("a").alias("column"), "corr").orderBy(F.desc_nulls_last("corr"), "column")


def ecdf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each distinct value (``value``, ``n``, ``cum``, ``ecdf``)."""
    counted = value_counts(df, value, by)
    scanned = key_scan(counted, "_key", [Scan("cum", "sum", "n"), Scan("total", "total", "n")],
                       by=by, order=["value"])
    return scanned.select(*by, "value", "n", "cum", (F.col("cum") / F.col("total")).alias("ecdf"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the whole range, the last one closed; empty bins are kept.

    Edges come from the extremes (widened by 0.5 each way for constant data).
    A value is moved to its neighbour bin if rounding put it across an edge.
    """
    x = F.col("x")
    data = df.select(F.col(value).cast("double").alias("x")).where(x.isNotNull())
    ends = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_e.hi")).otherwise(
            F.col("_e.lo") + i * ((F.col("_e.hi") - F.col("_e.lo")) / F.lit(float(bins))))

    width = F.col("_e.hi") - F.col("_e.lo")
    first = F.least(F.floor((x - F.col("_e.lo")) / width * F.lit(float(bins))), F.lit(bins - 1))
    placed = attach(data, ends, "_e").withColumn("bin", first)
    placed = placed.withColumn("bin", F.when(x < edge(F.col("bin")), F.col("bin") - 1)
                               .when((x >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1), F.col("bin") + 1)
                               .otherwise(F.col("bin")))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = attach(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), ends, "_e")
    return grid.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"))


def user_concentration(jobs: DataFrame, tops: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Number of users and share of jobs held by the busiest ones."""
    per_user = jobs.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    whole = per_user.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("jobs"))
    busiest = per_user.orderBy(F.desc("n"), "user").limit(max(tops)).agg(
        F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    shares = [
        (F.aggregate(F.slice("_t.ns", 1, k), F.lit(0).cast("bigint"), lambda a, n: a + n)
         / F.col("jobs")).alias(f"top{k}_share") for k in tops]
    return attach(whole, busiest, "_t").select("users", "jobs", *shares)


def quantile_marks(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, value, probs, by)
