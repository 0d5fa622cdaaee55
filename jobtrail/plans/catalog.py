"""Named queries over the job trace seen in the ``events`` table.

Each takes a session and a folder of Parquet tables and returns a DataFrame of
plain columns: integers as BIGINT, instants as BIGINT microseconds, doubles
rounded to six places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.functions.expressions import epoch_micros, log10p1, to_seconds
from jobtrail.functions.frames import require_columns
from jobtrail.operators import (
    arrivals, asof, boosting, capacity, checkpoints, daily_load, features, load, metrics, ml, policy, prep, queueing, sequences, splits, stats,
)
from jobtrail.plans.features import add_features, engineered_jobs, prepare_features
from jobtrail.schema import NUMERIC_FEATURES, REQUIRED_RAW, TARGET, heterogeneous_cluster, node_classes
from jobtrail.sources import experiments, traces
from jobtrail.sources.events import events_trace
from jobtrail.streaming import collect_counts, finish_load_stream, run_available, run_load_stream, stream_loads

Query = Callable[[SparkSession, str], DataFrame]

EXTRA = ("queue_id", "pred_us", "num_gpu")
# Machine classes (nodes, cpu, gpu) small enough that some jobs fit nowhere.
REDUCED_CLUSTER = node_classes([(10, 4.0, 1.0), (5, 8.0, 2.0)])
# Small models: the registered queries show the operators, not tuned quality.
SMALL_RF = {"numTrees": 10, "maxDepth": 6}
SMALL_GBT = {"maxIter": 8, "maxDepth": 4}
# Boosting of stumps shown round by round.
STUMP_ROUND = {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0}
STUMP_ROUNDS, PATIENCE_SHOWN = {"maxIter": 8, "maxDepth": 1, "stepSize": 0.5}, 3
SEQ_FEATURES = ["gpu_demand", "num_cpu", "job_runtime"]
SEQ_LEN = 4

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function name."""
    _QUERIES[function.__name__] = lambda spark, sf_dir: tidy(function(spark, sf_dir))
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("double", "float") or dtype.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        elif dtype in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif dtype.startswith("timestamp"):
            c = epoch_micros(c)
        out.append(c.alias(name))
    return df.select(*out)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_trace(spark, sf_dir)


def sparse_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with gaps: no GPU request, an unknown type and some unknown users become null."""
    return raw(spark, sf_dir).withColumns({
        "num_gpu": F.nullif(F.col("num_gpu"), F.lit(0.0)),
        "gpu_type": F.nullif(F.col("gpu_type"), F.lit("error")),
        "user": F.when(F.col("user") != "u3", F.col("user")),
    })


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.job_table(raw(spark, sf_dir), "us", extra=EXTRA)


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineered_jobs(raw(spark, sf_dir), "us", extra=EXTRA)


def split_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chrono_split(jobs(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    return queueing.policy_results(jobs(spark, sf_dir), keep=keep)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with several predicted runtimes (microseconds)."""
    return jobs(spark, sf_dir).withColumns({
        "pred_linear": F.greatest(F.col("pred_us"), F.lit(0)),
        "pred_half": F.floor(F.col("runtime_us") / 2).cast("bigint"),
        "pred_coarse": (F.floor(F.col("runtime_us") / 1_800_000_000) * 1_800_000_000).cast("bigint"),
    })


PREDICTORS = {"linear": "pred_linear", "half": "pred_half", "coarse": "pred_coarse"}


def predicted_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = metrics.predictions_long(predicted(spark, sf_dir), PREDICTORS, ["job_id", "gpu_type", "runtime_us"])
    return long.select("gpu_type", F.col("policy").alias("model"),
                       to_seconds(F.col("runtime_us")).alias("actual"),
                       to_seconds(F.col("predicted_runtime")).alias("predicted"))


# --- sources and projections -------------------------------------------------

@query
def raw_trace(spark, sf_dir):
    return raw(spark, sf_dir)


@query
def valid_jobs(spark, sf_dir):
    return prep.valid_jobs(sparse_raw(spark, sf_dir)).select("job_id", "duration", "num_gpu")


@query
def job_table(spark, sf_dir):
    return jobs(spark, sf_dir)


@query
def job_table_exact_gpu(spark, sf_dir):
    return prep.job_table(raw(spark, sf_dir), "us", gpu_mode="exact").select("job_id", "gpu_demand")


@query
def temporal_features(spark, sf_dir):
    return prep.add_temporal_features(jobs(spark, sf_dir)).select("job_id", "hour_of_day", "day_of_week")


@query
def fill_unknown(spark, sf_dir):
    return prep.fill_unknown(sparse_raw(spark, sf_dir)).select("job_id", "user", "gpu_type")


@query
def verify_features(spark, sf_dir):
    return stats.verify_table(engineered(spark, sf_dir), [*NUMERIC_FEATURES, TARGET])


@query
def scaled_replay(spark, sf_dir):
    test = split_jobs(spark, sf_dir).where(F.col("split") == "test")
    return prep.scaled_replay(test).select("job_id", "submit_time")


@query
def predictions_long(spark, sf_dir):
    return metrics.predictions_long(predicted(spark, sf_dir), PREDICTORS)


@query
def clip_predictions(spark, sf_dir):
    return metrics.clip_predictions(jobs(spark, sf_dir), ["pred_us"]).select("job_id", "pred_us")


# --- load and lookups --------------------------------------------------------

@query
def event_deltas(spark, sf_dir):
    return load.event_deltas(jobs(spark, sf_dir))


@query
def cluster_state(spark, sf_dir):
    return load.cluster_state(jobs(spark, sf_dir))


@query
def offered_load(spark, sf_dir):
    return load.offered_load(jobs(spark, sf_dir)).select(
        "job_id", "cluster_load_cpu", "cluster_load_gpu", "active_job_count")


@query
def asof_state(spark, sf_dir):
    """Load half a minute after each arrival."""
    table = jobs(spark, sf_dir)
    probes = table.select("job_id", (F.col("arrival_us") + 30_000_000).alias("t"))
    return load.asof_backward(probes, load.cluster_state(table), "t", ["load_cpu", "load_gpu", "active_jobs"])


def _minutes(spark, sf_dir):
    """Jobs with their arrival in whole minutes, so that instants repeat."""
    return jobs(spark, sf_dir).withColumn("minute", F.floor(F.col("arrival_us") / 60_000_000).cast("bigint"))


def _asof(spark, sf_dir, direction, tolerance=None, by=("queue_id",)):
    table = _minutes(spark, sf_dir)
    right = table.where(F.col("gpu_type") == "purchase").select(*by, "minute", F.col("job_id").alias("found"))
    return asof.asof_join(table.select("job_id", *by, "minute"), right, "minute", ["found"], list(by), direction, tolerance,
                          tie="found", at="found_minute").select("job_id", "found", "found_minute")


@query
def asof_nearest(spark, sf_dir):
    """The purchase of the same queue nearest to each job in time."""
    return _asof(spark, sf_dir, "nearest")


@query
def asof_forward(spark, sf_dir):
    """The next purchase anywhere, from each job's minute on."""
    return _asof(spark, sf_dir, "forward", by=())


@query
def asof_tolerance(spark, sf_dir):
    """The last purchase of the same queue within three hours before each job."""
    return _asof(spark, sf_dir, "backward", tolerance=180)


@query
def load_by_span(spark, sf_dir):
    """Load at arrival, the trace appended ten days at a time: each span reads its own jobs and the carry."""
    folder = checkpoints.fresh_path(spark, "load")
    step, previous, out = 10 * daily_load.DAY_US, None, None
    table = daily_load.deal_spans(jobs(spark, sf_dir), f"{folder}/jobs", step)
    ends = table.agg(F.min("start"), F.max("start")).first()
    for start in range(ends[0], ends[1] + 1, step):
        span = table.where(F.col("start") == start).drop("start")
        found = daily_load.append_span(span, folder, start, start + step, previous)
        out, previous = found if out is None else out.unionByName(found), start
    return out.select("job_id", "cluster_load_cpu", "cluster_load_gpu", "active_job_count")


@query
def utilization_timeline(spark, sf_dir):
    return load.utilization_timeline(jobs(spark, sf_dir), heterogeneous_cluster())


@query
def order_load(spark, sf_dir):
    """Orders open at each order date, from order date to last shipment (many equal instants)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shipped = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"), F.count(F.lit(1)).alias("lines"))
    spans = (orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
             .where(F.col("end") > F.col("o_orderdate"))
             .select(F.col("o_orderkey").alias("job_id"), epoch_micros(F.col("o_orderdate")).alias("arrival_us"),
                     (epoch_micros(F.col("end")) - epoch_micros(F.col("o_orderdate"))).alias("runtime_us"),
                     F.col("lines").alias("gpu_demand")))
    return load.offered_load(spans).select("job_id", "cluster_load_gpu", "active_job_count")


@query
def feasible_nodes(spark, sf_dir):
    return capacity.feasible_nodes(jobs(spark, sf_dir), REDUCED_CLUSTER, gpu="num_gpu").select(
        "job_id", "feasible_nodes", "first_fit")


def _machines(spark, sf_dir):
    """A machine per part: CPUs by its size, GPUs by its key."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("machine_id"), (F.col("p_size") / F.lit(3.0)).alias("cpu"),
                       (F.col("p_partkey") % 41 / F.lit(10.0)).alias("gpu"), (F.col("p_partkey") % 3).alias("nodes"))


@query
def fits_in_machine_table(spark, sf_dir):
    return capacity.fits_in_table(jobs(spark, sf_dir), _machines(spark, sf_dir), gpu="num_gpu").select(
        "job_id", "feasible_nodes", "first_fit")


@query
def fits_no_machine(spark, sf_dir):
    """Jobs that none of the smaller machines could hold."""
    small = _machines(spark, sf_dir).where("cpu < 12 AND gpu < 3.5")
    return capacity.fits_in_table(jobs(spark, sf_dir), small, gpu="num_gpu").where("feasible_nodes = 0") \
        .select("job_id", "num_cpu", "num_gpu")


@query
def unplaceable_jobs(spark, sf_dir):
    return capacity.unplaceable_jobs(jobs(spark, sf_dir), REDUCED_CLUSTER, gpu="num_gpu").select(
        "job_id", "num_cpu", "num_gpu")


# --- written and read back ---------------------------------------------------

@query
def csv_round_trip(spark, sf_dir):
    """The trace written as CSV, read by its header through the loader of its key, checked and cleaned."""
    path = checkpoints.fresh_path(spark, "trace") + ".csv"
    raw(spark, sf_dir).write.option("header", True).csv(path)
    loaded = traces.load_sample(spark, "main", traces.TracePaths(main=path))
    require_columns(loaded, REQUIRED_RAW)
    return prep.job_table(loaded, "us")


@query
def csv_baseline_round_trip(spark, sf_dir):
    """The same with times written as text, through the loader of the baseline trace."""
    path = checkpoints.fresh_path(spark, "baseline") + ".csv"
    text = F.date_format(F.timestamp_micros("submit_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw(spark, sf_dir).withColumn("submit_time", text).write.option("header", True).csv(path)
    paths = traces.TracePaths(main="", baseline=path, time_format="iso")
    return prep.job_table(traces.load_sample(spark, "baseline", paths)).select("job_id", "arrival_us", "arrival_sec", "job_runtime")


PROCESSED = ["job_id", "arrival_time", "arrival_sec", "job_runtime", "gpu_demand", "user", "gpu_type", "num_cpu", "hour_of_day",
             "cluster_load_gpu"]


@query
def job_table_round_trip(spark, sf_dir):
    """The engineered table written by arrival day as Parquet and loaded as the processed trace."""
    path = checkpoints.fresh_path(spark, "processed")
    traces.write_job_table(engineered(spark, sf_dir), path, by_day=True)
    return traces.load_sample(spark, "main_utilization", traces.TracePaths(main="", processed=path)).select(*PROCESSED)


@query
def job_table_csv(spark, sf_dir):
    """The engineered table written as CSV and read with the types it had."""
    path, table = checkpoints.fresh_path(spark, "processed-csv"), engineered(spark, sf_dir)
    traces.write_job_table(table, path, fmt="csv")
    return spark.read.schema(table.schema).options(header=True, **traces.CSV_TIMES).csv(path).select(*PROCESSED)


@query
def experiments_round_trip(spark, sf_dir):
    """Experiment records written as JSON, half of them in a second call, and all read back."""
    path, records = checkpoints.fresh_path(spark, "experiments"), _records(spark, sf_dir)
    experiments.write_experiments(records.where(F.col("model") == "linear"), path)
    experiments.write_experiments(records.where(F.col("model") != "linear"), path)
    return experiments.experiment_table(experiments.read_experiments(spark, path)).select("experiment", "mae", "rmse", "r2")


@query
def one_experiment(spark, sf_dir):
    path = checkpoints.fresh_path(spark, "experiments")
    experiments.write_experiments(_records(spark, sf_dir), path)
    return experiments.champion_parameters(experiments.read_experiment(spark, path, "purchase_half"))


@query
def model_round_trip(spark, sf_dir):
    """A tree saved, loaded again and applied to the test part."""
    rows, path = _stump_inputs(spark, sf_dir), checkpoints.fresh_path(spark, "model")
    whole = {"maxDepth": 1, "featureSubsetStrategy": "all", "numTrees": 1, "bootstrap": False}
    ml.save_model(ml.fit("rf", rows.where(F.col("split") == "train"), whole), path)
    return ml.score(rows.where(F.col("split") == "test"), {"tree": ml.load_model(path)}).select("job_id", "pred_tree")


@query
def holdouts(spark, sf_dir):
    """Rows held out for early stopping in cross-validation and in the final fit."""
    marked = splits.with_holdout(jobs(spark, sf_dir), ml.CV_HOLDOUT, name="is_val_cv")
    return splits.with_holdout(marked, ml.FIT_HOLDOUT, name="is_val_fit").select("job_id", "is_val_cv", "is_val_fit")


# --- statistics --------------------------------------------------------------

@query
def basic_stats(spark, sf_dir):
    return stats.basic_stats(jobs(spark, sf_dir))


@query
def workload_summary(spark, sf_dir):
    return stats.workload_summary(jobs(spark, sf_dir))


@query
def runtime_tails(spark, sf_dir):
    return stats.runtime_tails(jobs(spark, sf_dir))


@query
def runtime_hist(spark, sf_dir):
    return stats.histogram(jobs(spark, sf_dir), "job_runtime", 50)


@query
def runtime_hist_log(spark, sf_dir):
    logged = jobs(spark, sf_dir).withColumn("log_runtime", log10p1(F.col("job_runtime")))
    return stats.histogram(logged, "log_runtime", 60)


@query
def gpu_demand_counts(spark, sf_dir):
    return stats.value_frequencies(jobs(spark, sf_dir), "gpu_demand")


@query
def describe_numeric(spark, sf_dir):
    return stats.describe(jobs(spark, sf_dir), ["job_runtime", "gpu_demand", "num_cpu", "arrival_sec"])


@query
def missing_summary(spark, sf_dir):
    return stats.missing_summary(sparse_raw(spark, sf_dir))


@query
def table_info(spark, sf_dir):
    return stats.table_info(sparse_raw(spark, sf_dir).select("job_id", "duration", "num_gpu", "user", "gpu_type"))


@query
def corr_matrix(spark, sf_dir):
    return stats.correlation_matrix(engineered(spark, sf_dir), [*NUMERIC_FEATURES, TARGET])


@query
def corr_target(spark, sf_dir):
    return stats.target_correlation(engineered(spark, sf_dir), NUMERIC_FEATURES, TARGET)


@query
def runtime_ecdf(spark, sf_dir):
    return stats.ecdf(jobs(spark, sf_dir), "runtime_us")


@query
def user_concentration(spark, sf_dir):
    return stats.user_concentration(jobs(spark, sf_dir))


# --- arrivals ----------------------------------------------------------------

@query
def arrival_rate_rel(spark, sf_dir):
    return arrivals.arrival_rate(jobs(spark, sf_dir))


@query
def arrival_rate_5min(spark, sf_dir):
    return arrivals.arrival_rate(jobs(spark, sf_dir), 300_000_000)


@query
def arrival_rate_calendar(spark, sf_dir):
    return arrivals.calendar_rate(jobs(spark, sf_dir))


@query
def arrival_heatmap(spark, sf_dir):
    return arrivals.arrival_heatmap(prep.add_temporal_features(jobs(spark, sf_dir)))


@query
def arrival_heatmap_matrix(spark, sf_dir):
    wide = arrivals.heatmap_matrix(prep.add_temporal_features(jobs(spark, sf_dir)))
    return wide.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


@query
def inter_arrival(spark, sf_dir):
    return arrivals.inter_arrival(jobs(spark, sf_dir))


@query
def arrival_rate_stream(spark, sf_dir):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema) \
        .parquet(f"{sf_dir}/events*.parquet")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch(spark)
    run_available(timed, f"{folder}/counts", f"{folder}/state")
    return collect_counts(spark, f"{folder}/counts")


@query
def load_stream(spark, sf_dir):
    """Load at arrival of a stream: the trace in parts of ten days, every second one swapped with its neighbour."""
    table, folder = checkpoints.materialise(jobs(spark, sf_dir)), scratch(spark)
    first = table.agg(F.min("arrival_us")).first()[0]
    for part in (1, 0, 2, 3):
        at = F.floor((F.col("arrival_us") - first) / (10 * daily_load.DAY_US))
        table.where(at == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run_load_stream(stream, f"{folder}/out", f"{folder}/offsets", 20 * daily_load.DAY_US)
    finish_load_stream(table, f"{folder}/out")
    return stream_loads(spark, f"{folder}/out").select("job_id", "cluster_load_cpu", "cluster_load_gpu", "active_job_count")


def scratch(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder."""
    checkpoints.ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/run-{uuid.uuid4().hex}"


# --- splits and features -----------------------------------------------------

@query
def job_ordinal(spark, sf_dir):
    return splits.job_ordinal(jobs(spark, sf_dir)).select("job_id", "ordinal")


@query
def first_jobs(spark, sf_dir):
    return splits.first_jobs(jobs(spark, sf_dir), 3000).select("job_id", "arrival_us")


@query
def sample_jobs(spark, sf_dir):
    return splits.sample_jobs(jobs(spark, sf_dir), 3000).select("job_id", "job_runtime")


@query
def chrono_split(spark, sf_dir):
    return split_jobs(spark, sf_dir).select("job_id", "split")


@query
def test_split_jobs(spark, sf_dir):
    chosen = split_jobs(spark, sf_dir).where(F.col("split") == "test")
    return splits.rows_of_split(raw(spark, sf_dir), chosen).select("job_id", "submit_time", "user")


@query
def split_stats(spark, sf_dir):
    halves = split_jobs(spark, sf_dir)
    means = halves.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("mean_runtime"))
    marks = stats.quantile_marks(halves, TARGET, {"median_runtime": 0.5}, ["split"])
    return means.join(marks, "split")


@query
def hash_split(spark, sf_dir):
    return splits.hash_split(jobs(spark, sf_dir)).select("job_id", "split")


@query
def hash_split_sizes(spark, sf_dir):
    return splits.hash_split(jobs(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def chrono_val_split(spark, sf_dir):
    return splits.chrono_val_split(jobs(spark, sf_dir)).select("job_id", "split")


@query
def kfold_sizes(spark, sf_dir):
    return splits.with_fold(jobs(spark, sf_dir)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query
def sequences_strict(spark, sf_dir):
    rows = sequences.sequences_strict(jobs(spark, sf_dir), SEQ_FEATURES, SEQ_LEN)
    return sequences.flatten(rows, SEQ_FEATURES)


@query
def sequences_padded(spark, sf_dir):
    rows = sequences.sequences_padded(jobs(spark, sf_dir), SEQ_FEATURES, SEQ_LEN)
    return sequences.flatten(rows, SEQ_FEATURES)


@query
def sequences_test(spark, sf_dir):
    rows = sequences.sequences_test(split_jobs(spark, sf_dir), SEQ_FEATURES, SEQ_LEN)
    return sequences.flatten(rows, SEQ_FEATURES)


@query
def feature_table(spark, sf_dir):
    table = add_features(split_jobs(spark, sf_dir))
    return table.select("job_id", *NUMERIC_FEATURES, "user", "gpu_type", TARGET, "split")


@query
def numeric_features(spark, sf_dir):
    table = engineered(spark, sf_dir)
    return table.select("job_id", *features.feature_columns(table)[0])


@query
def feature_matrix(spark, sf_dir):
    return features.feature_matrix(jobs(spark, sf_dir), ["gpu_demand", "num_cpu"], ["user"])


@query
def minmax_scaled(spark, sf_dir):
    columns = ["arrival_sec", "num_cpu", "job_runtime"]
    table = split_jobs(spark, sf_dir)
    ranges = features.minmax_ranges(table.where(F.col("split") == "train"), columns)
    return features.minmax_scale(table, ranges, columns).select("job_id", *columns)


@query
def onehot_long(spark, sf_dir):
    table = split_jobs(spark, sf_dir)
    return features.onehot_long(table, table.where(F.col("split") == "train"), ["user", "gpu_type"])


@query
def categorical_index(spark, sf_dir):
    table = split_jobs(spark, sf_dir)
    indexed, _ = features.with_category_indexes(table, table.where(F.col("split") == "train"), ["user", "gpu_type"])
    return indexed.select("job_id", "user_index", "gpu_type_index")


# --- prediction quality ------------------------------------------------------

@query
def regression_metrics(spark, sf_dir):
    rows = predicted_long(spark, sf_dir).where(F.col("model") == "linear")
    return metrics.regression_metrics(rows, "actual", "predicted")


@query
def error_report(spark, sf_dir):
    return metrics.error_report(predicted_long(spark, sf_dir), "actual", "predicted", ["model"])


@query
def error_by_runtime_bin(spark, sf_dir):
    rows = predicted_long(spark, sf_dir).where(F.col("model") == "linear")
    return metrics.error_by_runtime_bin(rows, "actual", "predicted")


@query
def residual_hist(spark, sf_dir):
    rows = predicted_long(spark, sf_dir).where(F.col("model") == "linear")
    return metrics.residual_histogram(rows, "actual", "predicted", 40)


@query
def error_ecdf(spark, sf_dir):
    return metrics.error_ecdf(predicted(spark, sf_dir), "runtime_us", "pred_linear")


@query
def leaderboard(spark, sf_dir):
    table = metrics.regression_metrics(predicted_long(spark, sf_dir), "actual", "predicted", ["model"])
    by_mae = metrics.leaderboard(table, "mae").withColumnRenamed("rank", "rank_mae")
    return metrics.leaderboard(by_mae, "r2", ascending=False).withColumnRenamed("rank", "rank_r2") \
        .select("model", "mae", "r2", "rank_mae", "rank_r2")


@query
def experiment_ranking(spark, sf_dir):
    table = metrics.regression_metrics(predicted_long(spark, sf_dir), "actual", "predicted", ["gpu_type", "model"])
    return metrics.leaderboard(table, "mae", by=["gpu_type"]).select("gpu_type", "model", "mae", "rank")


def _records(spark, sf_dir):
    """One experiment record per machine class and predictor, with the track it belongs to."""
    table = metrics.regression_metrics(predicted_long(spark, sf_dir), "actual", "predicted", ["gpu_type", "model"])
    return table.select(
        F.concat_ws("_", "gpu_type", "model").alias("experiment"),
        F.struct("mae", "rmse", "r2", "mape", "mdae", F.lit(0.0).alias("train_time")).alias("metrics"),
        F.create_map(F.lit("model"), F.col("model"), F.lit("track"), F.col("gpu_type")).alias("best_params"),
        F.col("gpu_type").alias("track"), "model")


@query
def model_comparison(spark, sf_dir):
    records = _records(spark, sf_dir)
    both = experiments.union_experiments(records.where(F.col("model") == "linear"), records.where(F.col("model") != "linear"))
    return experiments.comparison_table(both.select("experiment", "metrics", "best_params"),
                                        records.select("experiment", "track", "model"))


@query
def champion_parameters(spark, sf_dir):
    return experiments.champion_parameters(_records(spark, sf_dir))


# --- queues and policies -----------------------------------------------------

@query
def queue_fifo(spark, sf_dir):
    return queueing.queue_fifo(jobs(spark, sf_dir))


@query
def queue_fifo_global(spark, sf_dir):
    """All jobs in one queue."""
    return queueing.queue_fifo(jobs(spark, sf_dir), by=()).select("job_id", "start_us", "completion_us")


@query
def busy_periods(spark, sf_dir):
    return queueing.busy_periods(jobs(spark, sf_dir))


@query
def pending_timeline(spark, sf_dir):
    return queueing.pending_timeline(jobs(spark, sf_dir))


@query
def next_job_per_queue(spark, sf_dir):
    return queueing.next_job(jobs(spark, sf_dir))


@query
def backlog_policies(spark, sf_dir):
    return results(spark, sf_dir).select("queue_id", "policy", "job_id", "waiting_us", "completion_us")


@query
def policy_results(spark, sf_dir):
    return queueing.waiting_seconds(results(spark, sf_dir)).select(
        "policy", "job_id", "waiting_time", "turnaround_time", "slowdown")


@query
def results_with_pred(spark, sf_dir):
    joined = policy.attach_predictions(results(spark, sf_dir), jobs(spark, sf_dir), ["pred_us", "job_runtime"])
    return joined.select("policy", "job_id", "waiting_us", "pred_us", "job_runtime")


@query
def policy_means(spark, sf_dir):
    return policy.policy_means(results(spark, sf_dir))


@query
def policy_summary(spark, sf_dir):
    rows = metrics.clip_predictions(results(spark, sf_dir, ["pred_us"]), ["pred_us"])
    return policy.policy_summary(rows, {"SJF-Pred": "pred_us"})


@query
def improvement_vs_fifo(spark, sf_dir):
    return policy.improvement_vs_baseline(results(spark, sf_dir))


@query
def improvement_matrix(spark, sf_dir):
    return policy.improvement_matrix(results(spark, sf_dir))


@query
def speedup_table(spark, sf_dir):
    return policy.speedup_table(results(spark, sf_dir))


@query
def wait_percentiles(spark, sf_dir):
    return policy.wait_percentiles(results(spark, sf_dir))


@query
def wait_ecdf(spark, sf_dir):
    return policy.wait_ecdf(results(spark, sf_dir))


@query
def slowdown_boxplot(spark, sf_dir):
    return policy.boxplot(results(spark, sf_dir))


@query
def wilcoxon(spark, sf_dir):
    return policy.wilcoxon(policy.paired_differences(results(spark, sf_dir)))


@query
def signed_rank_groups(spark, sf_dir):
    """Signed-rank tests within each user's jobs of a GPU type: few pairs, so exact."""
    diffs = policy.attach_predictions(policy.paired_differences(results(spark, sf_dir)), jobs(spark, sf_dir), ["user", "gpu_type"])
    return policy.signed_rank_test(diffs, ["policy", "user", "gpu_type"])


@query
def significance_table(spark, sf_dir):
    return policy.significance_table(results(spark, sf_dir))


# --- models ------------------------------------------------------------------

def _inputs(spark, sf_dir, mode="numeric_only"):
    return prepare_features(raw(spark, sf_dir), time_unit="us", feature_mode=mode)


@query
def rf_metrics(spark, sf_dir):
    inputs = _inputs(spark, sf_dir)
    return ml.evaluate(ml.fit("rf", inputs.train, SMALL_RF), inputs.test, clip=True)


@query
def gbt_metrics(spark, sf_dir):
    inputs = _inputs(spark, sf_dir, "with_categorical_onehot")
    return ml.evaluate(ml.fit("gbt", inputs.train, early_stopping=True), inputs.test)


@query
def gbt_l1_metrics(spark, sf_dir):
    inputs = _inputs(spark, sf_dir, "with_categorical_native")
    model = ml.fit("gbt_l1", inputs.train, categories=inputs.categories)
    return ml.evaluate(model, inputs.test)


@query
def stump_scores(spark, sf_dir):
    """One split on one feature, by a forest of one tree and by one round of boosting."""
    split = split_jobs(spark, sf_dir).withColumn("label", F.col(TARGET))
    rows, _ = features.assemble(split, split.where(F.col("split") == "train"), ["num_cpu"], [])
    train, whole = rows.where(F.col("split") == "train"), {"maxDepth": 1, "featureSubsetStrategy": "all"}
    models = {"tree": ml.fit("rf", train, {**whole, "numTrees": 1, "bootstrap": False}),
              "boosted": ml.fit("gbt", train, {**whole, "maxIter": 1, "subsamplingRate": 1.0})}
    return ml.score(rows.where(F.col("split") == "test"), models).select("job_id", "pred_tree", "pred_boosted")


def _stump_inputs(spark, sf_dir):
    """One feature, so that a tree of depth 1 is a single cut."""
    split = split_jobs(spark, sf_dir).withColumn("label", F.col(TARGET))
    return features.assemble(split, split.where(F.col("split") == "train"), ["num_cpu"], [])[0]


@query
def l1_stump_scores(spark, sf_dir):
    """One round of boosting under absolute error: a cut by the residuals' signs, a median in each leaf."""
    rows = _stump_inputs(spark, sf_dir)
    found = boosting.boost(rows.where(F.col("split") == "train"), "absolute", STUMP_ROUND)
    return ml.score(rows.where(F.col("split") == "test"), {"l1": found.model}).select("job_id", "pred_l1")


def _rounds(spark, sf_dir, loss):
    inputs = _stump_inputs(spark, sf_dir).where(F.col("split") == "train").select("job_id", "features", "label")
    train = splits.with_holdout(checkpoints.materialise(checkpoints.spread(inputs, "job_id")), ml.CV_HOLDOUT)
    found = boosting.boost(train, loss, STUMP_ROUNDS, "is_val", PATIENCE_SHOWN)
    return boosting.rounds_table(spark, found)


@query
def boosting_rounds_l1(spark, sf_dir):
    """Held-out error of each round of stumps under absolute error, up to where patience ends, and the best round."""
    return _rounds(spark, sf_dir, "absolute")


@query
def boosting_rounds_l2(spark, sf_dir):
    return _rounds(spark, sf_dir, "squared")


@query
def target_codes(spark, sf_dir):
    """Users and GPU types as numbers learnt from the runtimes of the train part."""
    coded = features.target_codes(split_jobs(spark, sf_dir), ["user", "gpu_type"], TARGET)
    return coded.select("job_id", "user_code", "gpu_type_code")


@query
def final_rf(spark, sf_dir):
    """The forest at its full size, fitted and judged."""
    inputs = _inputs(spark, sf_dir, "with_categorical_ordered")
    return ml.finalise("rf", inputs.train, inputs.test)[1].drop("train_time")


@query
def feature_importance(spark, sf_dir):
    inputs = _inputs(spark, sf_dir)
    return ml.feature_importance(ml.fit("rf", inputs.train, SMALL_RF), inputs.assembled)


@query
def random_search(spark, sf_dir):
    space = {"numTrees": [3, 5], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]}
    return ml.random_search("rf", _inputs(spark, sf_dir).train, space, n_iter=3)[1]


@query
def grid_search(spark, sf_dir):
    space = {"numTrees": [3, 5], "maxDepth": [4]}
    return ml.grid_search("rf", _inputs(spark, sf_dir).train, space)[1]


@query
def scored_jobs(spark, sf_dir):
    inputs = _inputs(spark, sf_dir)
    models = {"rf": ml.fit("rf", inputs.train, SMALL_RF), "gbt": ml.fit("gbt", inputs.train, SMALL_GBT)}
    return ml.score(inputs.test, models, clip=True).select("job_id", "label", "pred_rf", "pred_gbt")
