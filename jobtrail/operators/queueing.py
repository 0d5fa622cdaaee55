"""Waiting in queues: first-come-first-served recurrences and ordered backlogs as running scans.

Scans run in blocks along the composite order (see ``scan``), so neither a queue nor an instant has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtrail.functions.expressions import to_seconds
from jobtrail.operators.scan import BLOCK, Blocked, Scan, group_sizes, in_blocks, nested_sum, scan_blocked

QUEUE = "queue_id"


@dataclass(frozen=True)
class Policy:
    """A named order in which a backlog is worked off (BIGINT, smallest first)."""

    name: str
    key: Column


def standard_policies() -> list[Policy]:
    """Arrival order, shortest actual runtime first, shortest predicted runtime first."""
    return [
        Policy("FIFO", F.col("arrival_us")),
        Policy("SJF-Oracle", F.col("runtime_us")),
        Policy("SJF-Pred", F.greatest(F.col("pred_us"), F.lit(0))),
    ]


def _slowdown(turnaround: Column, runtime: Column) -> Column:
    return F.when(runtime > 0, F.try_divide(turnaround.cast("double"), runtime.cast("double"))) \
        .otherwise(F.lit(float("inf")))


def _fifo(jobs: DataFrame, by: Sequence[str], sizes: tuple[int, int] | None = None) -> Blocked:
    """Start and completion of each job on one server per queue, still in blocks.

    With W the running sum of runtimes, a job completes at its W plus the
    running maximum of (submit - W of the job before it). Both run in one pass: a
    block hands on its sum and its largest difference, and the blocks before it
    shift that difference by what they add up to.
    """
    narrow = jobs.select(*by, "job_id", F.col("arrival_us").alias("submit_us"), "runtime_us")
    blocked = in_blocks(narrow, by, ["submit_us", "job_id"], sizes)
    upto = blocked.window().rowsBetween(Window.unboundedPreceding, 0)
    before = blocked.window().rowsBetween(Window.unboundedPreceding, -1)
    block = [*blocked.keys, BLOCK]
    dealt = blocked.rows.repartition(*block) if blocked.cut else blocked.rows
    summed = dealt.withColumn("_sum", F.sum("runtime_us").over(upto))
    slack = F.col("submit_us") - (F.col("_sum") - F.col("runtime_us"))
    local = summed.withColumn("_slack", slack).withColumns({"_peak": F.max("_slack").over(upto),
                                                             "_peak_before": F.max("_slack").over(before)})
    carried, earlier = F.lit(0), F.lit(None).cast("bigint")
    if blocked.cut:
        totals = summed.groupBy(*block).agg(F.sum("runtime_us").alias("_all"), F.max(slack).alias("_most"))
        passed = Window.partitionBy(*blocked.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        shifted = totals.withColumn("_carried", F.coalesce(F.sum("_all").over(passed), F.lit(0)))
        handed = shifted.withColumn("_earlier", F.max(F.col("_most") - F.col("_carried")).over(passed))
        local = local.join(handed.select(*block, "_carried", "_earlier").hint("shuffle_hash"), block)
        carried, earlier = F.col("_carried"), F.col("_earlier")
    work = carried + F.col("_sum")
    peak, peak_before = (F.greatest(earlier, F.col(c) - carried) for c in ("_peak", "_peak_before"))
    timed = local.withColumns({"_free_us": work - F.col("runtime_us") + peak_before, "completion_us": work + peak}) \
        .withColumn("start_us", F.col("completion_us") - F.col("runtime_us"))
    kept = timed.select(*dict.fromkeys([*narrow.columns, *block, *blocked.order, "start_us", "completion_us", "_free_us"]))
    return replace(blocked, rows=kept)


def queue_fifo(jobs: DataFrame, by: Sequence[str] = (QUEUE,)) -> DataFrame:
    """Start, completion, waiting, turnaround and slowdown under first-come-first-served."""
    turnaround = F.col("completion_us") - F.col("submit_us")
    return _fifo(jobs, by).rows.select(
        *by, "job_id", "submit_us", "runtime_us", "start_us", "completion_us",
        (F.col("start_us") - F.col("submit_us")).alias("waiting_us"),
        turnaround.alias("turnaround_us"),
        _slowdown(turnaround, F.col("runtime_us")).alias("slowdown"))


def busy_periods(jobs: DataFrame, by: Sequence[str] = (QUEUE,)) -> DataFrame:
    """Uninterrupted working periods of each queue: begin, end, jobs, work."""
    timed = _fifo(jobs, by)
    opens = F.col("_free_us").isNull() | (F.col("submit_us") >= F.col("_free_us"))
    flagged = replace(timed, rows=timed.rows.withColumn("_opens", opens.cast("bigint")))
    numbered = scan_blocked(flagged, [Scan("period", "sum", "_opens")],
                            [*by, "start_us", "completion_us", "runtime_us"])
    return numbered.groupBy(*by, "period").agg(
        F.min("start_us").alias("begin_us"), F.max("completion_us").alias("end_us"),
        F.count(F.lit(1)).alias("jobs"), F.sum("runtime_us").alias("work_us"))


def pending_timeline(jobs: DataFrame, by: Sequence[str] = (QUEUE,)) -> DataFrame:
    """Jobs waiting in each queue from each instant on which that number may change."""
    largest, whole = group_sizes(jobs, by)
    timed = _fifo(jobs, by, (largest, whole)).rows
    steps = timed.select(*by, F.inline(F.array(
        F.struct(F.col("submit_us").alias("t"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(F.col("start_us").alias("t"), F.lit(-1).cast("bigint").alias("delta")))))
    net = steps.groupBy(*by, "t").agg(F.sum("delta").alias("delta"))
    # Each job changes the number at two instants at most.
    return nested_sum(net, ["t"], "delta", by, "pending", (2 * largest, 2 * whole)).select(*by, "t", "pending")


def _per_policy(jobs: DataFrame, policies: Sequence[Policy], columns: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(p.name).alias("policy"), p.key.cast("bigint").alias("order_key"))
                        for p in policies])
    return jobs.select(*columns, F.inline(entries))


def policy_results(jobs: DataFrame, policies: Sequence[Policy] | None = None, by: Sequence[str] = (QUEUE,),
                   keep: Sequence[str] = ()) -> DataFrame:
    """Work off each queue's whole backlog, present from time zero, under each policy.

    Ties of the policy's order go by submission, then job id. All policies run
    in one plan.
    """
    columns = [*by, "job_id", F.col("arrival_us").alias("submit_us"), "runtime_us", *keep]
    policies = policies or standard_policies()
    long = _per_policy(jobs, policies, columns)
    groups, order = [*by, "policy"], ["order_key", "submit_us", "job_id"]
    largest, whole = group_sizes(jobs, by)
    done = nested_sum(long, order, "runtime_us", groups, "completion_us", (largest, whole * len(policies)))
    waiting = F.col("completion_us") - F.col("runtime_us")
    return done.select(
        *groups, "job_id", "runtime_us", *keep, waiting.alias("waiting_us"),
        F.col("completion_us").alias("turnaround_us"), "completion_us",
        _slowdown(F.col("completion_us"), F.col("runtime_us")).alias("slowdown"))


def next_job(jobs: DataFrame, policies: Sequence[Policy] | None = None, by: Sequence[str] = (QUEUE,)) -> DataFrame:
    """The job each policy would take first from each queue."""
    long = _per_policy(jobs, policies or standard_policies(), [*by, "job_id", "arrival_us"])
    first = F.min_by(F.col("job_id"), F.struct("order_key", "arrival_us", "job_id"))
    return long.groupBy(*by, "policy").agg(first.alias("job_id"))


def waiting_seconds(results: DataFrame) -> DataFrame:
    """Results with waiting and turnaround in seconds."""
    return results.withColumns({"waiting_time": to_seconds(F.col("waiting_us")),
                                "turnaround_time": to_seconds(F.col("turnaround_us"))})
