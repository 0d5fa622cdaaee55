"""Comparison of queueing policies over per-job results."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.functions.expressions import exact_mean, to_seconds
from jobtrail.functions.frames import attach, null_safe_join, salted_join
from jobtrail.operators.metrics import ERROR_NAMES, error_aggregates
from jobtrail.operators.quantiles import quantiles, value_counts
from jobtrail.operators.scan import Scan, key_scan
from jobtrail.operators.stats import ecdf

BASELINE = "FIFO"
# Up to this many pairs the signed-rank test counts the exact distribution.
EXACT_PAIRS = 50
WAIT_MARKS = {"p50": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99, "max": 1.0}


def attach_predictions(results: DataFrame, jobs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Results with the true and predicted runtimes of their jobs."""
    return results.join(jobs.select("job_id", *columns), "job_id", "left")


def policy_means(results: DataFrame) -> DataFrame:
    """Mean waiting, completion time and slowdown per policy."""
    return results.groupBy("policy").agg(
        to_seconds(exact_mean(F.col("waiting_us"))).alias("mean_wait"),
        to_seconds(exact_mean(F.col("turnaround_us"))).alias("mean_jct"),
        F.avg("slowdown").alias("mean_slowdown"))


def policy_summary(results: DataFrame, predicted: Mapping[str, str] | None = None) -> DataFrame:
    """Waiting, completion time, slowdown and, for policies with a prediction, its errors.

    ``predicted`` maps a policy to the column of ``results`` (microseconds) it ordered by.
    """
    base = [
        F.count(F.lit(1)).alias("jobs"),
        to_seconds(exact_mean(F.col("waiting_us"))).alias("mean_wait"),
        to_seconds(exact_mean(F.col("turnaround_us"))).alias("mean_jct"),
        to_seconds(F.max("turnaround_us")).alias("max_jct"),
        F.avg("slowdown").alias("mean_slowdown")]
    marks = wait_percentiles(results, {"median_wait": 0.5, "p95_wait": 0.95})
    if not predicted:
        return results.groupBy("policy").agg(*base).join(marks, "policy", "left")
    used = None
    for name, column in predicted.items():
        used = (F if used is None else used).when(F.col("policy") == name, F.col(column))
    # Means and errors come out of one grouping; rows of policies without a prediction have no error.
    guess = to_seconds(used).cast("double")
    actual = F.when(guess.isNotNull(), to_seconds(F.col("runtime_us")).cast("double"))
    rows = results.withColumns({"_y": actual, "_p": F.when(actual.isNotNull(), guess), "_abs": F.abs(actual - guess)})
    errors = [a for a, name in zip(error_aggregates(), ERROR_NAMES) if name in ("mae", "rmse", "r2")]
    return rows.groupBy("policy").agg(*base, *errors).join(marks, "policy", "left").select(
        "policy", "jobs", "mean_wait", "mean_jct", "max_jct", "mean_slowdown", "median_wait", "p95_wait", "mae", "rmse", "r2")


def wait_percentiles(results: DataFrame, marks: Mapping[str, float] = WAIT_MARKS) -> DataFrame:
    """Exact percentiles of the waiting time per policy, in seconds."""
    found = quantiles(results, "waiting_us", marks, ["policy"])
    return found.select("policy", *[to_seconds(F.col(m)).alias(m) for m in marks])


def _gain(base: Column, x: Column) -> Column:
    return F.try_divide(base - x, base) * F.lit(100.0)


def improvement_vs_baseline(results: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Mean completion time per policy and its improvement over the baseline in percent."""
    means = policy_means(results).select("policy", "mean_jct")
    base = means.where(F.col("policy") == baseline).select("mean_jct")
    return (attach(means, base, "_b")
            .select("policy", "mean_jct",
                    F.round(_gain(F.col("_b.mean_jct"), F.col("mean_jct")), 2).alias("jct_improvement_pct"))
            .orderBy("mean_jct", "policy"))


def improvement_matrix(results: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Improvement over the baseline in waiting, completion time and slowdown."""
    means = policy_means(results)
    base = means.where(F.col("policy") == baseline).drop("policy")
    return attach(means, base, "_b").where(F.col("policy") != baseline).select("policy", *[
        _gain(F.col(f"_b.mean_{m}"), F.col(f"mean_{m}")).alias(f"{m}_gain_pct") for m in ("wait", "jct", "slowdown")
    ]).orderBy(F.desc("jct_gain_pct"), "policy")


def speedup_table(results: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Baseline over policy, for waiting, completion time and slowdown."""
    means = policy_means(results)
    base = means.where(F.col("policy") == baseline).drop("policy")
    return attach(means, base, "_b").select("policy", *[
        F.try_divide(F.col(f"_b.mean_{m}"), F.col(f"mean_{m}")).alias(f"{m}_speedup")
        for m in ("wait", "jct", "slowdown")])


def wait_ecdf(results: DataFrame) -> DataFrame:
    """Empirical distribution of the waiting time of each policy."""
    return ecdf(results, "waiting_us", ["policy"])


def boxplot(results: DataFrame, value: str = "slowdown", by: str = "policy") -> DataFrame:
    """Quartiles, whiskers (furthest data within 1.5 IQR) and outlier count; lowest median first."""
    boxes = quantiles(results, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    boxes = boxes.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)
    counted = value_counts(results, value, [by])
    placed = salted_join(counted, boxes, [by], ["value"])
    inside = (F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high"))
    return placed.groupBy(by).agg(
        F.any_value("q1").alias("q1"), F.any_value("median").alias("median"), F.any_value("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    ).orderBy("median", by)


def _upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 1.0 if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2.0)))


def paired_differences(results: DataFrame, baseline: str = BASELINE, value: str = "turnaround_us") -> DataFrame:
    """Baseline minus policy for the same job, for every other policy."""
    own = F.struct("policy", F.col(value).alias("_own"))
    # A job has one row per policy, so one grouping by job brings its results together.
    jobs = results.groupBy("job_id").agg(
        F.max(F.when(F.col("policy") == baseline, F.col(value))).alias("_base"),
        F.collect_list(F.when(F.col("policy") != baseline, own)).alias("_others"))
    pairs = jobs.where(F.col("_base").isNotNull()).select("job_id", "_base", F.inline("_others"))
    return pairs.select("policy", "job_id", (F.col("_base") - F.col("_own")).alias("diff"))


def wilcoxon(diffs: DataFrame, by: str = "policy") -> DataFrame:
    """Signed-rank test that differences are positive (zeros dropped, mean ranks for ties).

    Equal magnitudes are counted first; their ranks follow from a running count,
    so no group of differences is gathered. The p-value is the normal
    approximation with tie correction; with no non-zero difference the
    statistic is 0 and the p-value 1.
    """
    d = F.col("diff")
    ties = diffs.where(d.isNotNull() & (d != 0)).groupBy(by, F.abs(d).cast("bigint").alias("size")).agg(
        F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("_neg"))
    # Both branches of the scan read both counts, so the counting is planned once.
    ties = ties.select(by, "size", "n_pos", (F.col("n_pos") + F.col("_neg")).alias("n"))
    ranked = key_scan(ties, "size", [Scan("_upto", "sum", "n")], by=[by])
    n = F.col("n").cast("decimal(18,0)")
    # Twice the mean rank of a tie group stays an integer.
    double_rank = (F.lit(2) * F.col("_upto") - F.col("n") + F.lit(1)).cast("decimal(19,0)")
    sums = ranked.groupBy(by).agg(
        F.sum("n").alias("n"),
        (F.sum(double_rank * F.col("n_pos").cast("decimal(18,0)")).cast("double") / 2.0).alias("w_plus"),
        F.sum((n * n * n - n).cast("decimal(38,0)")).cast("double").alias("tie_term"))
    groups = diffs.select(by).distinct()
    full = groups.join(sums, by, "left").select(
        by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"),
        F.coalesce("tie_term", F.lit(0.0)).alias("tie_term"))
    size = F.col("n").cast("double")
    mean = size * (size + 1.0) / 4.0
    spread = F.sqrt((size * (size + 1.0) * (2.0 * size + 1.0) - F.col("tie_term") / 2.0) / 24.0)
    return full.withColumn("z", F.try_divide(F.col("w_plus") - mean, spread))


@lru_cache(maxsize=256)
def _tail_counts(ranks: tuple[int, ...]) -> np.ndarray:
    """For each doubled sum the number of sets of ``ranks`` that reach it; each rank adds the ways without it, moved by it."""
    ways = np.zeros(sum(ranks) + 1, dtype=np.int64)
    ways[0] = 1
    for rank in ranks:
        ways[rank:] += ways[:-rank].copy()
    return ways[::-1].cumsum()[::-1]


def _exact_tail(ranks: pd.Series, doubled: pd.Series) -> pd.Series:
    """Chance that the doubled rank sum reaches ``doubled`` when every rank is positive with probability 1/2.

    Groups without ties and of equal size share their ranks, so their counts are kept. Null ranks have no chance.
    """
    return pd.Series([None if r is None else float(_tail_counts(tuple(sorted(map(int, r))))[int(d)]) / 2.0 ** len(r)
                      for r, d in zip(ranks, doubled)], dtype="float64")


def signed_rank_test(diffs: DataFrame, by: Sequence[str] = ("policy",), exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """Signed-rank test per group with its one-sided p-value: ``n, w_plus, z, p_value, exact``.

    Up to ``exact_pairs`` non-zero differences the p-value is exact, ties
    included: the distribution of the rank sum is counted over doubled mean
    ranks, which are integers. Larger groups use the normal approximation with tie
    correction. Zeros and nulls are dropped; a group with nothing left has n = 0
    and p = 1. Differences are counted per magnitude first and at most
    ``exact_pairs`` magnitudes of a group are listed, so no group is gathered.
    """
    if exact_pairs > 60:
        raise ValueError("Counts of more than 60 pairs do not fit 64 bits.")
    by, d = list(by), F.col("diff")
    ties = diffs.where(d.isNotNull() & (d != 0)).groupBy(*by, F.abs(d).cast("bigint").alias("size")).agg(
        F.count_if(d > 0).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    ranked = key_scan(ties, "size", [Scan("_upto", "sum", "n")], by=by)
    double_rank = F.lit(2) * F.col("_upto") - F.col("n") + F.lit(1)
    count, positive = (F.col(c).cast("decimal(18,0)") for c in ("n", "n_pos"))
    listed = F.when(F.col("_upto") <= exact_pairs, F.array_repeat(double_rank, F.col("n").cast("int")))
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(double_rank.cast("decimal(19,0)") * positive).alias("_doubled"),
        F.sum((count * count * count - count).cast("decimal(38,0)")).cast("double").alias("_ties"),
        F.flatten(F.collect_list(listed)).alias("_ranks"))
    full = null_safe_join(diffs.select(*by).distinct(), sums, by, "left").fillna(0, ["n"])
    size, tie_term = F.col("n").cast("double"), F.coalesce("_ties", F.lit(0.0))
    w_plus = F.coalesce(F.col("_doubled").cast("double") / 2.0, F.lit(0.0))
    spread = F.sqrt((size * (size + 1.0) * (2.0 * size + 1.0) - tie_term / 2.0) / 24.0)
    z = F.try_divide(w_plus - size * (size + 1.0) / 4.0, spread)
    exact = F.col("n") <= exact_pairs
    exact_tail = F.pandas_udf(_exact_tail, "double")
    counted = exact & (F.col("n") > 0)
    doubled = F.coalesce(F.when(counted, F.col("_doubled").cast("bigint")), F.lit(0).cast("bigint"))
    tested = full.select(*by, "n", w_plus.alias("w_plus"), z.alias("z"), exact.alias("exact"),
                         exact_tail(F.when(counted, F.col("_ranks")), doubled).alias("_p"))
    upper_tail = F.pandas_udf(_upper_tail, "double")
    p_value = F.when(F.col("exact"), F.coalesce("_p", F.lit(1.0))).otherwise(upper_tail(F.col("z")))
    return tested.select(*by, "n", "w_plus", "z", p_value.alias("p_value"), "exact")


def significance_table(results: DataFrame, baseline: str = BASELINE, level: float = 0.05) -> DataFrame:
    """Signed-rank test of each policy against the baseline with mean completion times."""
    upper_tail = F.pandas_udf(_upper_tail, "double")
    means = policy_means(results).select("policy", "mean_jct")
    base = means.where(F.col("policy") == baseline).select("mean_jct")
    tests = wilcoxon(paired_differences(results, baseline))
    joined = attach(tests.join(means, "policy"), base, "_b")
    return (joined.withColumn("p_value", upper_tail(F.col("z")))
            .select("policy", "mean_jct", (F.col("_b.mean_jct") - F.col("mean_jct")).alias("jct_vs_baseline"),
                    F.col("w_plus").alias("wilcoxon_w"), "p_value",
                    (F.col("p_value") < F.lit(level)).alias("significant"))
            .orderBy(F.desc("jct_vs_baseline"), "policy"))
