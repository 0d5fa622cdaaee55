"""Plans stay free of single-task scans over rows, cross joins and unpruned reads."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from jobtrail.operators import load, prep, splits
from jobtrail.plans import catalog

LARGE = ["offered_load", "cluster_state", "asof_state", "runtime_ecdf", "inter_arrival", "chrono_split",
         "sequences_strict", "queue_fifo", "queue_fifo_global", "pending_timeline", "policy_results",
         "policy_summary", "slowdown_boxplot", "wilcoxon", "feature_table", "onehot_long", "feasible_nodes"]


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("name", LARGE)
def test_no_cross_join(spark, small, name):
    text = plan(driver.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_feasibility_needs_no_shuffle(spark, small):
    assert "Exchange" not in plan(driver.queries()["feasible_nodes"](spark, small)).split("Subquery")[0]


def test_delta_counting_is_shared(spark, small):
    table = prep.job_table(catalog.raw(spark, small), "us")
    state = load.cluster_state(table)
    state.collect()
    assert "ReusedExchange" in plan(state)


@pytest.fixture
def trace_table(spark, small, tmp_path):
    path = str(tmp_path / "trace")
    catalog.raw(spark, small).write.parquet(path)
    return spark.read.parquet(path)


def test_validity_filter_and_columns_reach_the_scan(spark, trace_table):
    table = prep.job_table(trace_table, "us").select("job_id", "job_runtime")
    text = plan(table)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(duration,0.0\).*GreaterThan\(num_gpu,0.0\)", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "user" not in schema and "queue_id" not in schema


def test_split_becomes_a_pushed_filter(spark, small, tmp_path):
    path = str(tmp_path / "jobs")
    prep.job_table(catalog.raw(spark, small), "us").write.parquet(path)
    table = spark.read.parquet(path)
    test = splits.chrono_split(table).where(F.col("split") == "test")
    assert test.count() == -(-table.count() // 5)
    pushed = splits.chrono_split(table).where(F.col("split") == "test").select("job_id")
    assert "arrival_us" in re.search(r"DataFilters: \[(.*?)\]", plan(pushed)).group(1)


NO_CUT = ["queue_fifo", "queue_fifo_global", "busy_periods", "pending_timeline", "policy_results", "job_ordinal",
          "sequences_strict", "onehot_long", "wilcoxon"]


@pytest.mark.parametrize("name", NO_CUT)
def test_nothing_is_written_in_between(spark, small, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("written cut")
    monkeypatch.setattr("jobtrail.operators.checkpoints.ensure_checkpoint_dir", refuse)
    driver.queries()[name](spark, small)


@pytest.mark.parametrize("name,most", [("queue_fifo", 1), ("busy_periods", 2), ("policy_results", 1), ("pending_timeline", 3)])
def test_ordered_scans_shuffle_rows_once(spark, small, name, most):
    df = driver.queries()[name](spark, small)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= most


@pytest.mark.parametrize("name", ["queue_fifo", "runtime_ecdf", "wilcoxon", "cluster_state"])
def test_no_single_partition_holds_the_rows(spark, small, name):
    """Executed plans may bring single rows together, never the rows of a scan."""
    df = driver.queries()[name](spark, small)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    for line in re.findall(r".*Exchange SinglePartition.*\n.*\n.*", text):
        assert re.search(r"partial_|keys=\[\]|keys=\[_parent|TakeOrdered", line), line
