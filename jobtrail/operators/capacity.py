"""Which machines could hold a job on an idle cluster.

A cluster described by a few classes is part of the plan (``feasible_nodes``); a
table of machines of any size is met by dominance counting (``fits_in_table``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.functions.expressions import order_key
from jobtrail.functions.frames import salted_join, unused
from jobtrail.operators.asof import asof_join
from jobtrail.operators.scan import Scan, in_blocks, scan_blocked, with_ordinal
from jobtrail.schema import NodeClass

# Fixed value: rounding tolerance of a capacity check.
TOLERANCE = 1e-5


def _fits(node: NodeClass, cpu: Column, gpu: Column, mem: Column) -> Column:
    fits = (cpu <= F.lit(node.cpu + TOLERANCE)) & (gpu <= F.lit(node.gpu + TOLERANCE))
    if node.mem > 0:
        fits = fits & (mem <= F.lit(node.mem + TOLERANCE))
    return fits


def feasible_nodes(jobs: DataFrame, cluster: Sequence[NodeClass], cpu: str = "num_cpu", gpu: str = "gpu_demand",
                   mem: str | None = None) -> DataFrame:
    """Add the number of machines a job fits on and the first of them (null if none).

    The cluster is a short description by machine class, so the check is a
    projection over the jobs: nothing is joined or shuffled.
    """
    need_mem = F.col(mem) if mem else F.lit(0.0)
    checks = [(c, _fits(c, F.col(cpu), F.col(gpu), need_mem)) for c in cluster if c.nodes > 0]
    count = F.lit(0).cast("bigint")
    firsts = []
    for node, fits in checks:
        count = count + F.when(fits, F.lit(node.nodes).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        firsts.append(F.when(fits, F.lit(node.first_id).cast("bigint")))
    none = F.lit(None).cast("bigint")
    return (jobs.withColumn("feasible_nodes", count)
            .withColumn("first_fit", F.least(none, none, *firsts) if firsts else none))


def unplaceable_jobs(jobs: DataFrame, cluster: Sequence[NodeClass], cpu: str = "num_cpu", gpu: str = "gpu_demand",
                     mem: str | None = None) -> DataFrame:
    """Jobs that no machine of the cluster can ever hold."""
    return feasible_nodes(jobs, cluster, cpu, gpu, mem).where(F.col("feasible_nodes") == 0) \
        .drop("feasible_nodes", "first_fit")


def dominance_counts(needs: DataFrame, machines: DataFrame) -> DataFrame:
    """For distinct ``cpu, gpu`` needs the ``machines`` (``machine_id, cpu, gpu, nodes``) that hold both: ``cpu, gpu, nodes, first_fit``.

    Machines are ranked by CPU. The ranks that hold a need's CPU are all from
    some rank on, which is a union of at most one aligned block of ranks per
    power of two; a machine lies in one block of each size. Within a block, machines
    and needs are put in the order of falling GPU and a running sum counts the machines
    passed. Both sides grow by the logarithm of the distinct CPU sizes, no pair is
    formed, and a block of any size is scanned in parts. Needs that nothing holds
    are left out.
    """
    key = lambda c: order_key(c + F.lit(TOLERANCE), "double")
    plain = lambda c: order_key(c, "double")
    machines = machines.where("cpu IS NOT NULL AND gpu IS NOT NULL AND nodes > 0")
    sizes = machines.select(key(F.col("cpu").cast("double")).alias("at")).distinct()
    ranks = with_ordinal(sizes, ["at"], name="rank").withColumn("rank", F.col("rank") - 1)
    levels = max(1, (sizes.count() - 1).bit_length())
    asked = needs.where("cpu IS NOT NULL AND gpu IS NOT NULL").withColumn("at", plain(F.col("cpu").cast("double")))
    placed = asof_join(asked, ranks, "at", ["rank"], direction="forward").where("rank IS NOT NULL")
    one_before = F.col("rank") - 1
    steps = F.sequence(F.lit(0), F.lit(levels - 1))
    open_steps = F.filter(steps, lambda b: F.call_function("shiftright", one_before, b).bitwiseAND(F.lit(1)) == 0)
    cover = F.when(F.col("rank") == 0, F.array(F.struct(F.lit(levels).alias("level"), F.lit(0).cast("bigint").alias("part")))) \
        .otherwise(F.transform(open_steps, lambda b: F.struct(
            b.alias("level"), (F.call_function("shiftright", one_before, b) + 1).alias("part"))))
    wanted = placed.select("cpu", "gpu", F.inline(cover)) \
        .withColumn("falling", -plain(F.col("gpu").cast("double"))).withColumn("asked", F.lit(1))
    own = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda b: F.struct(
        b.alias("level"), F.call_function("shiftright", F.col("rank"), b).alias("part")))
    ranked = machines.withColumn("at", key(F.col("cpu").cast("double"))).join(ranks, "at")
    passed = ranked.select(
        F.inline(own), (-key(F.col("gpu").cast("double"))).alias("falling"), "nodes", "machine_id")
    passed = passed.groupBy("level", "part", "falling").agg(F.sum("nodes").alias("nodes"), F.max(-F.col("machine_id")).alias("low"))
    none = F.lit(None).cast("double")
    timeline = passed.select("level", "part", "falling", F.lit(0).alias("asked"), none.alias("cpu"), none.alias("gpu"), "nodes", "low") \
        .unionByName(wanted.select("level", "part", "falling", "asked", F.col("cpu").cast("double"), F.col("gpu").cast("double"),
                                   F.lit(0).cast("bigint").alias("nodes"), F.lit(None).cast("bigint").alias("low")))
    # Machines of the very size come before the needs.
    blocked = in_blocks(timeline, ["level", "part"], ["falling", "asked"])
    scanned = scan_blocked(blocked, [Scan("held", "sum", "nodes"), Scan("lowest", "max", "low")], ["cpu", "gpu", "asked"])
    found = scanned.where(F.col("asked") == 1).groupBy("cpu", "gpu").agg(
        F.sum("held").alias("nodes"), (-F.max("lowest")).alias("first_fit"))
    return found.where(F.col("nodes") > 0)


def fits_in_table(jobs: DataFrame, machines: DataFrame, cpu: str = "num_cpu", gpu: str = "gpu_demand",
                  spread: str = "job_id") -> DataFrame:
    """Add ``feasible_nodes`` and ``first_fit`` (smallest machine id, null if none) from a table of machines.

    ``machines`` has ``machine_id, cpu, gpu, nodes``: ``nodes`` machines under one id. Jobs are reduced to their
    distinct needs, which are counted and joined back; a need of many jobs is
    split then. A job or machine without a number for CPU or GPU fits nothing.
    """
    need_cpu, need_gpu = f"{unused('_need', jobs)}_cpu", f"{unused('_need', jobs)}_gpu"
    asking = jobs.withColumns({need_cpu: F.col(cpu).cast("double"), need_gpu: F.col(gpu).cast("double")})
    needs = asking.select(F.col(need_cpu).alias("cpu"), F.col(need_gpu).alias("gpu")).distinct()
    table = machines.select("machine_id", F.col("cpu").cast("double"), F.col("gpu").cast("double"), F.col("nodes").cast("bigint"))
    counted = dominance_counts(needs, table).select(
        F.col("cpu").alias(need_cpu), F.col("gpu").alias(need_gpu), F.struct("nodes", "first_fit").alias(f"{need_cpu}_found"))
    joined = salted_join(asking, counted, [need_cpu, need_gpu], [spread], how="left")
    found = F.col(f"{need_cpu}_found")
    return joined.select(*jobs.columns, F.coalesce(found["nodes"], F.lit(0).cast("bigint")).alias("feasible_nodes"),
                         found["first_fit"].alias("first_fit"))
