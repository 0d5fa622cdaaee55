"""Hand-computed results on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import arrivals, capacity, features, load, metrics, policy, prep, queueing, sequences, splits, stats
from jobtrail.schema import heterogeneous_cluster, node_classes

RAW = "job_id bigint, submit_time bigint, duration double, num_gpu double, user string, gpu_type string"
SECOND = 1_000_000


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def jobs(spark, *rows):
    """Rows of (job_id, arrival second, runtime second[, gpu])."""
    return spark.createDataFrame(
        [(r[0], r[1] * SECOND, r[2] * SECOND, r[3] if len(r) > 3 else 1) for r in rows],
        "job_id bigint, arrival_us bigint, runtime_us bigint, gpu_demand int")


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("job_id").collect()]


# --- job table ---------------------------------------------------------------

def test_job_table(spark):
    table = prep.job_table(raw(spark, (5, 7200, 12.5, 3.0, "ida", "L4"), (8, 7950, 90.0, 1.0, "sam", "A10")))
    assert by_id(table, "job_runtime", "gpu_demand", "arrival_sec") == [(12.5, 3, 0.0), (90.0, 1, 750.0)]
    assert str(table.orderBy("job_id").first()["arrival_time"]).startswith("1970-01-01 02:00:00")


def test_nanoseconds_are_divided_exactly(spark):
    table = prep.job_table(raw(spark, (1, 1_600_000_000_000_000_999, 1.0, 1.0, "a", "x")), "ns")
    assert table.first()["arrival_us"] == 1_600_000_000_000_000


def test_missing_column(spark):
    with pytest.raises(ValueError, match="Required column"):
        prep.job_table(spark.createDataFrame([(1,)], "job_id bigint"))


def test_invalid_rows_are_dropped_before_time_zero(spark):
    table = prep.job_table(raw(
        spark, (1, 10, None, 1.0, "a", "x"), (2, 20, 0.0, 1.0, "a", "x"), (3, 30, -1.0, 1.0, "a", "x"),
        (4, 40, 1.0, None, "a", "x"), (5, 50, 1.0, 0.0, "a", "x"), (6, 60, 1.0, 0.5, "a", "x")))
    assert by_id(table, "job_id", "arrival_sec", "gpu_demand") == [(6, 0.0, 0)]


def test_exact_gpu_mode(spark):
    table = prep.job_table(raw(spark, (1, 0, 1.0, 0.5, "a", "x")), gpu_mode="exact")
    assert table.first()["gpu_demand"] == 0.5


@pytest.mark.parametrize("unit,factor", [("s", 1), ("ms", 1000), ("us", 1_000_000), ("ns", 1_000_000_000)])
def test_time_units(spark, unit, factor):
    table = prep.job_table(raw(spark, (1, 5 * factor, 1.0, 1.0, "a", "x"), (2, 8 * factor, 1.0, 1.0, "a", "x")), unit)
    assert by_id(table, "arrival_us", "arrival_sec") == [(5 * SECOND, 0.0), (8 * SECOND, 3.0)]


def test_text_times_and_temporal_features(spark):
    text = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1.0, 1.0, "a", "x")],
                                 RAW.replace("submit_time bigint", "submit_time string"))
    row = prep.add_temporal_features(prep.job_table(text)).first()
    assert (row["hour_of_day"], row["day_of_week"]) == (10, 0)


def test_optional_columns_are_kept_when_present(spark):
    base = raw(spark, (1, 0, 1.0, 1.0, "a", "x"))
    assert "num_cpu" not in prep.job_table(base).columns
    assert "num_cpu" in prep.job_table(base.withColumn("num_cpu", F.lit(3))).columns


def test_fill_unknown(spark):
    filled = prep.fill_unknown(raw(spark, (1, 0, 1.0, 1.0, None, None))).first()
    assert (filled["user"], filled["gpu_type"]) == ("unknown", "unknown")


def test_scaled_replay(spark):
    replay = prep.scaled_replay(jobs(spark, (1, 100, 1), (2, 200, 1)))
    assert by_id(replay, "submit_time") == [(0.0,), (40.0,)]


# --- load --------------------------------------------------------------------

def test_load_is_half_open(spark):
    loaded = load.offered_load(jobs(spark, (1, 0, 10), (2, 10, 10), (3, 15, 5)))
    assert by_id(loaded, "active_job_count") == [(0,), (0,), (1,)]


def test_simultaneous_arrivals_see_each_other(spark):
    loaded = load.offered_load(jobs(spark, (1, 0, 5, 2), (2, 0, 5, 3)))
    assert by_id(loaded, "active_job_count", "cluster_load_gpu") == [(1, 3), (1, 2)]


def test_load_without_cpu_column(spark):
    loaded = load.offered_load(jobs(spark, (1, 0, 5), (2, 1, 5)))
    assert by_id(loaded, "cluster_load_cpu") == [(0,), (0,)]


def test_deltas_cancel_and_state_ends_empty(spark):
    table = jobs(spark, *[(i, (i * 37) % 50, 1 + i % 7) for i in range(60)])
    total = load.event_deltas(table).agg(F.sum("change_count"), F.sum("d_gpu")).first()
    assert tuple(total) == (0, 0)
    state = load.cluster_state(table).orderBy("t").collect()
    assert state[-1]["active_jobs"] == 0 and min(r["active_jobs"] for r in state) == 0


def test_asof_backward(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 1), (4, "b", 99), (5, "a", 10)],
                                 "job_id bigint, g string, t bigint")
    right = spark.createDataFrame([("a", 2, 20), ("a", 10, 100)], "g string, t bigint, v bigint")
    joined = load.asof_backward(left, right, "t", ["v"], by=["g"])
    assert by_id(joined, "v") == [(20,), (100,), (None,), (None,), (100,)]


def test_utilization_without_gpus(spark):
    row = load.utilization_timeline(jobs(spark, (1, 0, 5, 2)), node_classes([(1, 4.0, 0.0)])).orderBy("t").first()
    assert row["gpu_util"] == 2.0


# --- statistics --------------------------------------------------------------

def numbers(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")


def test_histogram_closes_last_bin(spark):
    rows = stats.histogram(numbers(spark, range(11)), "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 2, 2, 2, 3]
    assert (rows[0]["left"], rows[-1]["right"]) == (0.0, 10.0)


def test_histogram_of_constant(spark):
    rows = stats.histogram(numbers(spark, [3, 3, 3]), "x", 2).orderBy("bin").collect()
    assert (rows[0]["left"], rows[-1]["right"], [r["n"] for r in rows]) == (2.5, 3.5, [0, 3])


def test_correlation(spark):
    table = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, 0.0), (4.0, 9.0, 5.0, 3.0)],
                                  "a double, b double, c double, d double")
    found = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_matrix(table, ["a", "b", "c", "d"]).collect()}
    assert found["a", "a"] == pytest.approx(1.0)
    assert found["a", "b"] == pytest.approx(table.corr("a", "b"))
    assert found["a", "d"] == pytest.approx(table.where("d is not null").corr("a", "d"))
    assert found["a", "c"] is None and found["c", "c"] is None


def test_correlation_far_from_zero(spark):
    table = spark.range(100).select((F.col("id") + 1.7e9).alias("a"), ((F.col("id") * 37) % 100 + F.col("id") * 1e-3).alias("b"))
    found = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_matrix(table, ["a", "b"]).collect()}
    assert found["a", "a"] == pytest.approx(1.0, abs=1e-9)
    assert found["a", "b"] == pytest.approx(table.corr("a", "b"), abs=1e-6)


def test_ecdf_ends_at_one(spark):
    rows = stats.ecdf(numbers(spark, [2, 1, 2, 7, None]), "x").orderBy("value").collect()
    assert [(r["value"], r["ecdf"]) for r in rows] == [(1.0, 0.25), (2.0, 0.75), (7.0, 1.0)]


def test_missing_summary(spark):
    rows = stats.missing_summary(spark.createDataFrame([(1, None, None), (2, None, 3)], "a int, b int, c int")).collect()
    assert [tuple(r) for r in rows] == [("b", 2, 100.0), ("c", 1, 50.0)]


def test_quantile_of_infinite_and_empty(spark):
    rows = numbers(spark, [1.0, 2.0, float("inf")])
    assert stats.quantile_marks(rows, "x", {"m": 0.5}).first()["m"] == 2.0
    assert stats.quantile_marks(rows.where("x < 0"), "x", {"m": 0.5}).first()["m"] is None


# --- arrivals ----------------------------------------------------------------

def test_arrival_gap_is_filled(spark):
    rate = arrivals.arrival_rate(jobs(spark, (1, 0, 1), (2, 7200, 1))).orderBy("bin")
    assert [r["n"] for r in rate.collect()] == [1, 0, 1]


def test_calendar_hours(spark):
    rate = arrivals.calendar_rate(jobs(spark, (1, 3599, 1), (2, 3600, 1), (3, 3 * 3600, 1))).orderBy("hour_us")
    assert [r["n"] for r in rate.collect()] == [1, 1, 0, 1]


def test_inter_arrival_drops_ties(spark):
    gaps = arrivals.inter_arrival(jobs(spark, (1, 5, 1), (2, 5, 1), (3, 9, 1), (4, 6, 1))).orderBy("arrival_us")
    assert [r["gap_sec"] for r in gaps.collect()] == [1.0, 3.0]


def test_heatmap_has_all_cells(spark):
    table = spark.createDataFrame([(0, 10), (0, 10), (6, 23)], "day_of_week int, hour_of_day int")
    assert arrivals.arrival_heatmap(table).count() == 168
    assert arrivals.arrival_heatmap(table, full=False).count() == 2


# --- splits and features -----------------------------------------------------

def test_chrono_split_rounds_test_up(spark):
    split = splits.chrono_split(jobs(spark, *[(i, 11 - i, 1) for i in range(11)]))
    parts = by_id(split, "split")
    assert parts == [("test",)] * 3 + [("train",)] * 8


def test_chrono_split_cuts_inside_one_instant(spark):
    split = splits.chrono_split(jobs(spark, *[(i, 7, 1) for i in range(10)]))
    assert by_id(split, "split") == [("train",)] * 8 + [("test",)] * 2


def test_chrono_split_of_nothing(spark):
    assert splits.chrono_split(jobs(spark, (1, 0, 1)).where("job_id > 5")).count() == 0


def test_chrono_val_split(spark):
    split = splits.chrono_val_split(jobs(spark, *[(i, i, 1) for i in range(20)]), seq_len=4)
    # 16 train rows, 13 windows, 2 of them for validation.
    assert [p for p, in by_id(split, "split")] == ["warmup"] * 3 + ["train"] * 11 + ["val"] * 2 + ["test"] * 4


def test_hash_split_has_exact_size(spark):
    split = splits.hash_split(jobs(spark, *[(i, i, 1) for i in range(101)]))
    assert split.where("split = 'test'").count() == 21
    other = splits.hash_split(jobs(spark, *[(i, i, 1) for i in range(101)]).repartition(7))
    assert by_id(split, "split") == by_id(other, "split")


def test_sequences(spark):
    table = jobs(spark, *[(i, i, 10 + i) for i in range(4)])
    strict = by_id(sequences.sequences_strict(table, ["runtime_us"], 3), "job_id", "sequence")
    padded = by_id(sequences.sequences_padded(table, ["runtime_us"], 3), "job_id", "sequence")
    step = [[float((10 + i) * SECOND)] for i in range(4)]
    assert strict == [(2, step[0:3]), (3, step[1:4])]
    assert padded == [(0, [step[0]] * 3), (1, [step[0], step[0], step[1]]), (2, step[0:3]), (3, step[1:4])]


def test_sequences_cross_blocks(spark):
    table = jobs(spark, *[(i, i, 1) for i in range(50)]).withColumn("v", F.col("job_id") * 10)
    narrow = sequences._windows(table, ["v"], 4, [], block_rows=5)
    wide = sequences._windows(table, ["v"], 4, [])
    assert by_id(narrow, "job_id", "sequence") == by_id(wide, "job_id", "sequence")


def test_minmax_constant_column(spark):
    table = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 5.0)], "job_id bigint, a double, b double")
    ranges = features.minmax_ranges(table, ["a", "b"])
    scaled = features.minmax_scale(table, ranges, ["a", "b"])
    assert by_id(scaled, "a", "b") == [(0.0, 0.0), (0.0, 1.0)]
    assert by_id(features.minmax_restore(scaled, ranges, "b", "b"), "b") == [(1.0,), (5.0,)]


def test_onehot_unseen_category_is_zero(spark):
    train = spark.createDataFrame([(1, "b", 1.0), (2, "a", 1.0), (3, "c", 1.0)], "job_id bigint, user string, x double")
    test = spark.createDataFrame([(9, "zzz", 1.0), (8, "c", 1.0)], train.schema)
    out, categories = features.assemble(train.unionByName(test), train, ["x"], ["user"], "with_categorical_onehot")
    vectors = {r["job_id"]: list(r["features"].toArray()) for r in out.collect()}
    assert categories == 4
    assert vectors == {2: [1, 1, 0, 0], 1: [1, 0, 1, 0], 3: [1, 0, 0, 1], 8: [1, 0, 0, 1], 9: [1, 0, 0, 0]}


def test_unknown_feature_mode(spark):
    with pytest.raises(ValueError, match="feature_mode"):
        features.assemble(numbers(spark, [1]), numbers(spark, [1]), ["x"], [], "other")


def test_feature_matrix_checks_columns(spark):
    with pytest.raises(ValueError, match="has no"):
        features.feature_matrix(jobs(spark, (1, 0, 1)), ["nope"], [])


# --- metrics -----------------------------------------------------------------

def scores(spark, pairs):
    table = spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "y double, p double")
    return metrics.regression_metrics(table, "y", "p").first()


def test_regression_metrics(spark):
    row = scores(spark, [(4, 7), (12, 8), (16, 16), (8, 6)])
    assert row["mae"] == pytest.approx(9 / 4) and row["mdae"] == 2.5
    assert row["rmse"] == pytest.approx(math.sqrt(29 / 4)) and row["r2"] == pytest.approx(1 - 29 / 80)
    assert set(row.asDict()) == {"mae", "rmse", "r2", "mape", "mdae"}


def test_mape_ignores_zero_targets(spark):
    assert scores(spark, [(0, 5), (8, 10)])["mape"] == pytest.approx(0.25)
    assert math.isnan(scores(spark, [(0, 1), (0, 1)])["mape"])


def test_r2_of_constant_target(spark):
    assert scores(spark, [(5, 5), (5, 5)])["r2"] == 1.0
    assert scores(spark, [(5, 4), (5, 5)])["r2"] == 0.0


def test_clip_and_residual_sign(spark):
    table = spark.createDataFrame([(1, 5, -3)], "job_id bigint, y bigint, p bigint")
    assert metrics.clip_predictions(table, ["p"]).first()["p"] == 0
    assert metrics.with_residual(table, "y", "p").first()["residual"] == -8
    assert metrics.with_residual(table, "y", "p", "actual-pred").first()["residual"] == 8


# --- queues and policies -----------------------------------------------------

def queue(spark, *rows):
    return jobs(spark, *rows).withColumn("queue_id", F.lit(1).cast("bigint")) \
        .withColumn("pred_us", F.col("runtime_us"))


def test_fifo(spark):
    out = queueing.queue_fifo(queue(spark, (1, 0, 10), (2, 5, 10), (3, 50, 1)))
    assert by_id(out, "start_us", "completion_us") == [
        (0, 10 * SECOND), (10 * SECOND, 20 * SECOND), (50 * SECOND, 51 * SECOND)]


def test_busy_periods(spark):
    out = queueing.busy_periods(queue(spark, (1, 0, 10), (2, 5, 10), (3, 20, 1), (4, 50, 1))).orderBy("period")
    assert [(r["begin_us"] // SECOND, r["end_us"] // SECOND, r["jobs"]) for r in out.collect()] == [
        (0, 20, 2), (20, 21, 1), (50, 51, 1)]


def test_pending_counts_waiting_jobs(spark):
    out = queueing.pending_timeline(queue(spark, (1, 0, 10), (2, 5, 10), (3, 6, 1))).orderBy("t")
    assert [(r["t"] // SECOND, r["pending"]) for r in out.collect()] == [(0, 0), (5, 1), (6, 2), (10, 1), (20, 0)]


def test_backlog_shortest_first(spark):
    out = queueing.policy_results(queue(spark, (1, 0, 20), (2, 0, 5))).where("policy = 'SJF-Oracle'")
    assert by_id(out, "waiting_us", "completion_us") == [(5 * SECOND, 25 * SECOND), (0, 5 * SECOND)]


def test_user_policy_and_next_job(spark):
    mine = [queueing.Policy("longest", -F.col("runtime_us"))]
    table = queue(spark, (1, 0, 3), (2, 0, 9), (3, 1, 9))
    assert queueing.next_job(table, mine).first()["job_id"] == 2
    assert by_id(queueing.policy_results(table, mine), "waiting_us") == [(18 * SECOND,), (0,), (9 * SECOND,)]


def test_zero_runtime_slowdown_is_infinite(spark):
    out = queueing.policy_results(queue(spark, (1, 0, 0))).where("policy = 'FIFO'").first()
    assert out["slowdown"] == math.inf


def diffs(spark, values):
    return spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "policy string, job_id bigint, diff bigint")


def test_wilcoxon_ranks(spark):
    row = policy.wilcoxon(diffs(spark, [1, -1, 2, 0, 3])).first()
    assert (row["n"], row["w_plus"], row["tie_term"]) == (4, 8.5, 6.0)
    assert row["z"] == pytest.approx((8.5 - 5.0) / math.sqrt((4 * 5 * 9 - 3.0) / 24))


def test_wilcoxon_without_differences(spark):
    row = policy.wilcoxon(diffs(spark, [0, 0])).first()
    assert (row["n"], row["w_plus"], row["z"]) == (0, 0.0, None)


def test_significance(spark):
    table = queue(spark, *[(i, i, 200 - i) for i in range(100)])
    rows = {r["policy"]: r for r in policy.significance_table(queueing.policy_results(table)).collect()}
    assert rows["SJF-Oracle"]["jct_vs_baseline"] > 0
    assert 0.0 <= rows["SJF-Oracle"]["p_value"] <= 1.0


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = policy.boxplot(spark.createDataFrame([("p", v) for v in values], "policy string, slowdown double")).first()
    assert tuple(row) == ("p", 2.0, 3.0, 4.0, 1.0, 4.0, 1)


# --- capacity ----------------------------------------------------------------

def test_feasible_nodes(spark):
    table = spark.createDataFrame([(1, 64, 0.0), (2, 65, 1.0), (3, 1, 2.0), (4, 97, 0.0), (5, 1, 8.0)],
                                  "job_id bigint, num_cpu int, gpu_demand double")
    cluster = heterogeneous_cluster(2, 4, 3)
    out = capacity.feasible_nodes(table, cluster)
    assert by_id(out, "feasible_nodes", "first_fit") == [(9, 0), (2, 0), (6, 0), (0, None), (2, 0)]
    assert by_id(capacity.unplaceable_jobs(table, cluster), "job_id") == [(4,)]


# --- orders with gaps --------------------------------------------------------

def test_jobs_without_arrival_come_last(spark):
    rows = [(i, 100 - i, 1) for i in range(8)] + [(8, None, 1), (9, None, 1)]
    table = spark.createDataFrame(rows, "job_id bigint, arrival_us bigint, runtime_us bigint")
    split = dict(by_id(splits.chrono_split(table), "job_id", "split"))
    assert [i for i, part in split.items() if part == "test"] == [8, 9]
    half = dict(by_id(splits.chrono_split(table, 0.1), "job_id", "split"))
    assert [i for i, part in half.items() if part == "test"] == [9]


def test_folds_holdouts_and_samples_are_exact(spark):
    table = spark.range(101).select(F.col("id").alias("job_id"))
    sizes = [r["count"] for r in splits.with_fold(table, 4).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [25, 25, 25, 26]
    assert splits.with_holdout(table, 0.15).where("is_val").count() == 16
    assert splits.sample_jobs(table, 7).count() == 7
    assert splits.sample_jobs(table, 500).count() == 101


def test_a_stray_timestamp_makes_a_long_grid(spark):
    table = spark.createDataFrame([(1, 0), (2, 40_000_000_000)], "job_id bigint, arrival_us bigint")
    grid = arrivals.arrival_rate(table, 1_000_000)
    assert grid.count() == 40_001
    assert grid.agg(F.sum("n"), F.max("bin"), F.countDistinct("bin")).first()[:] == (2, 40_000, 40_001)
