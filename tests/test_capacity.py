"""Machine tables of any size against trying every pair."""

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import capacity, scan
from tests.test_plans import plan

MACHINES = "machine_id long, cpu double, gpu double, nodes long, level int"
JOBS = "job_id long, num_cpu int, gpu_demand double, part string, asked int, _need0_cpu string"


def brute(jobs, machines):
    def fits(j, m):
        known = None not in (j[1], j[2], m[1], m[2])
        return known and m[3] and j[1] <= m[1] + capacity.TOLERANCE and j[2] <= m[2] + capacity.TOLERANCE
    out = {}
    for j in jobs:
        held = [m for m in machines if fits(j, m)]
        out[j[0]] = (sum(m[3] for m in held), min((m[0] for m in held), default=None))
    return out


@pytest.mark.parametrize("block_rows,kinds", [(1 << 20, 40), (25, 40), (12, 1)])
def test_every_pair(spark, monkeypatch, block_rows, kinds):
    for name in ("GROUP_ROWS", "WHOLE_ROWS", "MOST_ROWS"):
        monkeypatch.setattr(scan, name, block_rows)
    rng = random.Random(block_rows + kinds)
    machines = [(i, float(rng.randint(1, kinds)), rng.choice([0.0, 1.5, 2.0, float(rng.randint(0, 8))]), rng.choice([0, 1, 3]), 1) for i in range(90)]
    machines += [(500, None, 2.0, 1, 1), (501, 9.0, None, 1, 1), (502, 4.0, 4.0, None, 1), (-7, 5.0, 3.0, 2, 1)]
    jobs = [(i, rng.choice([None, 4, rng.randint(0, kinds + 2)]), rng.choice([None, 0.0, 1.5, 1.50001, 1.5001, rng.uniform(0, 9)]), "p", 1, "n")
            for i in range(150)]
    frame, table = spark.createDataFrame(jobs, JOBS), spark.createDataFrame(machines, MACHINES)
    got = capacity.fits_in_table(frame, table)
    assert got.columns == [*frame.columns, "feasible_nodes", "first_fit"]
    assert {r.job_id: (r.feasible_nodes, r.first_fit) for r in got.collect()} == brute(jobs, machines)
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_sides(spark):
    jobs = spark.createDataFrame([(1, 1, 0.0, "p", 1, "n")], JOBS)
    table = spark.createDataFrame([(1, 4.0, 1.0, 2, 1)], MACHINES)
    assert capacity.fits_in_table(jobs, table.limit(0)).first()[-2:] == (0, None)
    assert capacity.fits_in_table(jobs.limit(0), table).count() == 0


def test_ten_thousand_classes(spark):
    """Sizes that are all different, with needs that many jobs share."""
    n = 10_000
    table = spark.range(n).select(F.col("id").alias("machine_id"), (F.col("id") * 7919 % n / 8.0).alias("cpu"),
                                  (F.col("id") * 104729 % n / 16.0).alias("gpu"), F.lit(1).alias("nodes"))
    jobs = spark.range(3000).select(F.col("id").alias("job_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 11 * 100).otherwise(50).alias("num_cpu"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") % 13 * 40).otherwise(7).alias("gpu_demand"))
    got = capacity.fits_in_table(jobs, table).select("num_cpu", "gpu_demand", "feasible_nodes", "first_fit").distinct().collect()
    sizes = [(i * 7919 % n / 8.0, i * 104729 % n / 16.0, i) for i in range(n)]
    for r in got:
        held = [i for c, g, i in sizes if r.num_cpu <= c + 1e-5 and r.gpu_demand <= g + 1e-5]
        assert (r.feasible_nodes, r.first_fit) == (len(held), min(held, default=None))
