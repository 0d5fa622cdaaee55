"""Reading and writing traces, job tables, experiments and models."""

import json

import pytest
from pyspark.sql import functions as F

from jobtrail import sources
from jobtrail.operators import features, ml, prep
from jobtrail.plans.features import engineered_jobs, prepare_features
from jobtrail.sources.experiments import champion_parameters, comparison_table
from jobtrail.sources.traces import TracePaths


@pytest.fixture
def csv_trace(tmp_path):
    path = tmp_path / "trace.csv"
    path.write_text("job_id,submit_time,duration,num_gpu,user,gpu_type,note\n"
                    "11,4000,35.5,1,ida,L4,x\n12,4600,17.25,0.5,,A10,y\n13,4700,,1,sam,L4,z\n")
    return str(path)


def test_csv_trace_has_explicit_types(spark, csv_trace):
    table = sources.raw_trace(spark, csv_trace)
    assert dict(table.dtypes) == {"job_id": "bigint", "submit_time": "bigint", "duration": "double",
                                  "num_gpu": "double", "user": "string", "gpu_type": "string", "note": "string"}
    assert prep.job_table(table).count() == 2


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.raw_trace(spark, str(tmp_path / "none.csv"))


def test_csv_text_times(spark, tmp_path):
    path = tmp_path / "text.csv"
    path.write_text("job_id,submit_time,duration,num_gpu,num_cpu,user,gpu_type\n"
                    "1,2021-03-04 05:06:07,60,1,8.0,u,x\n2,2021-03-04 05:07:07,60,1,,u,x\n")
    table = prep.job_table(sources.raw_trace(spark, str(path), time_format="yyyy-MM-dd HH:mm:ss")).orderBy("job_id")
    rows = table.collect()
    assert [r["arrival_us"] for r in rows] == [1_614_834_367_000_000, 1_614_834_427_000_000]
    assert [r["num_cpu"] for r in rows] == [8, None]
    assert prep.job_table(sources.raw_trace(spark, str(path), time_format="iso")).count() == 2
    with pytest.raises(Exception, match="submit_time holds a value that is no bigint: 2021-03-04 05:06:07"):
        sources.raw_trace(spark, str(path)).collect()


@pytest.mark.parametrize("column,value", [("num_cpu", "8.5"), ("duration", "long"), ("job_id", "a1")])
def test_csv_values_that_do_not_parse_end_the_job(spark, tmp_path, column, value):
    row = {"job_id": "1", "submit_time": "5", "duration": "2.5", "num_gpu": "1", "num_cpu": "4", "user": "u",
           "gpu_type": "x", column: value}
    path = tmp_path / "bad.csv"
    path.write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    with pytest.raises(Exception, match=f"Column {column} holds"):
        sources.raw_trace(spark, str(path)).collect()


def test_csv_files_may_order_columns_differently(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("job_id,submit_time,duration,num_gpu,user,gpu_type\n1,100,7,1,u,x\n")
    (folder / "b.csv").write_text("\ufeffduration,gpu_type,submit_time,job_id,num_gpu,user,num_cpu\n9,y,200,2,2,v,3.0\n")
    rows = {r["job_id"]: r.asDict() for r in sources.raw_trace(spark, str(folder)).collect()}
    assert (rows[1]["submit_time"], rows[1]["duration"], rows[1]["num_cpu"]) == (100, 7.0, None)
    assert (rows[2]["submit_time"], rows[2]["duration"], rows[2]["num_cpu"], rows[2]["gpu_type"]) == (200, 9.0, 3, "y")


def test_dispatch(spark, csv_trace, tmp_path):
    paths = TracePaths(main=csv_trace)
    assert sources.load_sample(spark, "main", paths).count() == 3
    with pytest.raises(ValueError, match="baseline"):
        sources.load_sample(spark, "baseline", paths)
    with pytest.raises(ValueError, match="Unknown dataset"):
        sources.load_sample(spark, "other", paths)
    with pytest.raises(FileNotFoundError, match="write the job table first"):
        sources.load_sample(spark, "main_utilization", TracePaths(csv_trace, processed=str(tmp_path / "none")))


@pytest.mark.parametrize("by_day", [False, True])
def test_job_table_round_trip(spark, csv_trace, tmp_path, by_day):
    table = engineered_jobs(sources.raw_trace(spark, csv_trace))
    path = str(tmp_path / "jobs")
    sources.write_job_table(table, path, by_day=by_day)
    again = sources.read_job_table(spark, path)
    names = table.columns
    assert [dict(again.dtypes)[c] for c in names] == [dict(table.dtypes)[c] for c in names]
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, table.collect()))


def test_csv_sink_has_header(spark, csv_trace, tmp_path):
    path = str(tmp_path / "jobs_csv")
    sources.write_job_table(engineered_jobs(sources.raw_trace(spark, csv_trace)), path, "csv")
    back = spark.read.option("header", True).csv(path)
    assert {r["user"] for r in back.collect()} == {"ida", "unknown"}


def test_two_records_of_one_experiment_are_both_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    frame = sources.read_experiments(spark, path)
    metrics = {"mae": 1.0, "rmse": 2.0, "r2": 0.1, "mape": 0.2, "mdae": 0.3, "train_time": 4.0}
    two = spark.createDataFrame([("e", metrics, {"a": "1"}), ("e", {**metrics, "mae": 9.0}, {"a": "2"})], frame.schema)
    sources.write_experiments(two.coalesce(1), path)
    assert sorted(r["metrics"]["mae"] for r in sources.read_experiments(spark, path).collect()) == [1.0, 9.0]


def test_experiment_files(spark, tmp_path):
    (tmp_path / "exp_b.json").write_text(json.dumps(
        {"metrics": {"mae": 2.0, "rmse": 3.0, "r2": 0.5, "mape": 1.0, "mdae": 1.5, "train_time": 4.0},
         "best_params": {"depth": 8, "rate": 0.05, "subset": "sqrt"}}, indent=2))
    (tmp_path / "exp_a.json").write_text(json.dumps(
        {"metrics": {"mae": 1.0, "rmse": 2.0, "r2": 0.6, "train_time": 5.0}, "best_params": {"units": 64}}, indent=2))
    found = sources.read_experiments(spark, str(tmp_path))
    rows = {r["experiment"]: r for r in found.collect()}
    assert list(rows) == ["exp_a", "exp_b"]
    assert rows["exp_a"]["metrics"]["mape"] is None and rows["exp_b"]["best_params"]["rate"] == "0.05"
    assert sources.read_experiment(spark, str(tmp_path), "exp_c") is None
    assert sources.read_experiment(spark, str(tmp_path), "exp_a").count() == 1
    labels = spark.createDataFrame([("exp_a", "A", "net"), ("exp_b", "A", "trees")], "experiment string, track string, model string")
    assert [(r["model"], r["place"]) for r in comparison_table(found, labels).collect()] == [("net", 1), ("trees", 2)]
    params = {r["experiment"]: json.loads(r["params"]) for r in champion_parameters(found).collect()}
    assert params["exp_a"] == {"units": "64"}


def test_experiments_written_one_by_one(spark, small, tmp_path):
    inputs = prepare_features(sources.events_trace(spark, small), time_unit="us")
    path = str(tmp_path / "experiments")
    assert sources.read_experiments(spark, path).count() == 0
    for name, trees in (("exp_one", 2), ("exp_two", 3)):
        params = {"numTrees": trees, "maxDepth": 3}
        model, quality = ml.finalise("rf", inputs.train, inputs.test, params)
        sources.write_experiments(ml.experiment_record(spark, name, quality, params), path)
    rows = sources.read_experiments(spark, path).collect()
    assert [r["experiment"] for r in rows] == ["exp_one", "exp_two"]
    assert rows[1]["best_params"] == {"numTrees": "3", "maxDepth": "3"} and rows[1]["metrics"]["train_time"] > 0
    ml.save_model(model, str(tmp_path / "model"))
    again = ml.load_model(str(tmp_path / "model"))
    first = model.transform(inputs.test).agg(F.sum("prediction")).first()
    assert again.transform(inputs.test).agg(F.sum("prediction")).first() == first


@pytest.mark.parametrize("mode", ["numeric_only", "with_categorical_native", "with_categorical_onehot", "with_categorical"])
def test_feature_modes_share_the_split(spark, small, mode):
    inputs = prepare_features(sources.events_trace(spark, small), time_unit="us", feature_mode=mode)
    total = inputs.jobs.count()
    assert inputs.test.count() == -(-total // 5)
    last = inputs.train.agg(F.max("arrival_us")).first()[0]
    assert last <= inputs.test.agg(F.min("arrival_us")).first()[0]
    assert inputs.numeric[0] == "gpu_demand" and inputs.categorical == ["user", "gpu_type"]
    ml.fit("rf", inputs.train, {"numTrees": 2, "maxDepth": 2}, categories=inputs.categories)


def test_prepare_from_processed_and_shuffled(spark, small):
    table = engineered_jobs(sources.events_trace(spark, small), "us")
    inputs = prepare_features(processed=table, shuffle=True)
    assert inputs.test.count() == -(-table.count() // 5)
    with pytest.raises(ValueError):
        prepare_features()
    with pytest.raises(ValueError, match="feature_mode"):
        prepare_features(table, feature_mode="other")


def test_native_categories_reach_the_learner(spark, small):
    inputs = prepare_features(sources.events_trace(spark, small), time_unit="us", feature_mode="with_categorical_native")
    attrs = inputs.assembled.schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in attrs["nominal"]] == ["user_index", "gpu_type_index"]
    assert [a["num_vals"] for a in attrs["nominal"]][1] == inputs.train.select("gpu_type").distinct().count() + 1


def test_onehot_importances_are_named(spark, small):
    inputs = prepare_features(sources.events_trace(spark, small), time_unit="us", feature_mode="with_categorical_onehot")
    model = ml.fit("rf", inputs.train, {"numTrees": 2, "maxDepth": 3})
    names = features.category_names(inputs.train, inputs.categorical)
    table = ml.feature_importance(model, inputs.assembled, top=None, names=names).collect()
    found = {r["feature"] for r in table}
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)
    assert "gpu_type_click" in found and "gpu_demand" in found


def test_early_stopping_needs_fewer_trees(spark, small):
    inputs = prepare_features(sources.events_trace(spark, small), time_unit="us")
    params = {"maxIter": 15, "maxDepth": 6, "stepSize": 1.0}
    stopped = ml.fit("gbt", inputs.train, params, early_stopping=True)
    assert stopped.getNumTrees < ml.fit("gbt", inputs.train, params).getNumTrees


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="Unknown model"):
        ml.estimator("other")
