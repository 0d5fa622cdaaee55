"""Runtime predictors: fitting, tuning, scoring and comparing Spark ML models."""

from __future__ import annotations

import itertools
import json
import random
import re
import time
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from jobtrail.operators import boosting, forest, wide
from jobtrail.operators.checkpoints import materialise
from jobtrail.operators.metrics import regression_metrics
from jobtrail.operators.splits import with_fold, with_holdout

# Default parameters of each learner.
DEFAULTS = {
    "rf": {"numTrees": 150, "maxDepth": 15, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"},
    "gbt": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8,
            "featureSubsetStrategy": "0.5", "minInstancesPerNode": 1},
    "gbt_l1": {"maxIter": 1000, "stepSize": 0.02, "maxDepth": 7, "subsamplingRate": 0.8,
               "featureSubsetStrategy": "0.5", "minInstancesPerNode": 20},
}

# Search spaces of each learner.
SPACES = {
    "rf": {"numTrees": [100, 150], "maxDepth": [10, 15], "minInstancesPerNode": [1, 2],
           "featureSubsetStrategy": ["sqrt", "0.7"], "subsamplingRate": [0.5, 0.8]},
    "gbt": {"maxIter": [300, 500, 800], "stepSize": [0.05], "maxDepth": [6, 8, 10],
            "minInstancesPerNode": [1, 5], "subsamplingRate": [0.7, 0.8],
            "featureSubsetStrategy": ["0.3", "0.5"]},
    "gbt_l1": {"maxIter": [500, 1000, 1500], "stepSize": [0.01, 0.02, 0.05], "maxDepth": [5, 7, 10],
               "minInstancesPerNode": [20, 50], "subsamplingRate": [0.7, 0.8],
               "featureSubsetStrategy": ["0.3", "0.5", "0.7"]},
}

# Shares of the train rows held out for early stopping in cross-validation and in the final fit.
CV_HOLDOUT, FIT_HOLDOUT = 0.15, 0.10
# Rounds without improvement after which boosting ends, in the final fit and in cross-validation.
PATIENCE, CV_PATIENCE = {"gbt": 50, "gbt_l1": 100}, 50
BOOSTED = {"gbt": "squared", "gbt_l1": "absolute"}


def estimator(kind: str, params: Mapping | None = None, seed: int = 42, categories: int = 0):
    """Spark's random forest, or boosted trees with squared (``gbt``) or absolute (``gbt_l1``) error.

    Spark's trees for absolute error keep mean leaves; ``fit`` uses median ones.
    """
    if kind not in DEFAULTS:
        raise ValueError(f"Unknown model: {kind!r}")
    settings = {**DEFAULTS[kind], **(params or {})}
    common = {"featuresCol": "features", "labelCol": "label", "seed": seed, "maxBins": _bins(categories)}
    if kind == "rf":
        return RandomForestRegressor(**common, **settings)
    return GBTRegressor(lossType=BOOSTED[kind], **common, **settings)


def _bins(categories: int) -> int:
    """Trees need at least one bin per category."""
    return max(32, categories)


def fit_boosted(kind: str, train: DataFrame, params: Mapping | None = None, seed: int = 42, categories: int = 0,
                holdout: float | None = FIT_HOLDOUT, patience: int | None = None) -> boosting.Boosted:
    """Boost; with ``holdout`` the best round on held-out rows, before patience runs out, ends the model.

    Inputs with categories are boosted in one task if it can hold the rows. Others: squared
    error is Spark's own boosting, whose rounds are judged afterwards; absolute error has
    median leaves and ends with its patience. Inputs of many categories have the trees of ``wide``.
    """
    settings, patience = {**DEFAULTS[kind], **(params or {})}, patience or PATIENCE[kind]
    split = None if holdout is None else with_holdout(train, holdout, seed)
    found = boosting.boost_in_memory(train if split is None else split, BOOSTED[kind], settings, None if split is None else "is_val",
                                     None if split is None else patience, seed, _bins(categories))
    if found is not None:
        return found
    if BOOSTED[kind] == "absolute":
        return boosting.boost(train if split is None else split, "absolute", settings, None if split is None else "is_val",
                              None if split is None else patience, seed, _bins(categories))
    fitted = train if split is None else split.where(~F.col("is_val"))
    learner = wide.learner(fitted, _bins(categories))
    model = estimator(kind, params, seed, categories).fit(fitted) if learner is None else \
        boosting.boost_wide(fitted, learner, settings, seed, _bins(categories))
    if split is None:
        return boosting.Boosted(model, [], model.getNumTrees)
    return boosting.stopped(model, split.where("is_val"), patience)


def fit(kind: str, train: DataFrame, params: Mapping | None = None, early_stopping: bool = False, seed: int = 42,
        categories: int = 0, holdout: float = FIT_HOLDOUT, patience: int | None = None):
    """Fit one model; early stopping ends boosting when a held-out part has not improved for ``patience`` rounds."""
    if kind in BOOSTED:
        return fit_boosted(kind, train, params, seed, categories, holdout if early_stopping else None, patience).model
    return estimator(kind, params, seed, categories).fit(train)


def _clipped(column: str, clip: bool) -> Column:
    return F.greatest(column, F.lit(0.0)) if clip else F.col(column)


def evaluate(model, test: DataFrame, clip: bool = False) -> DataFrame:
    """Metrics of a model on a test part; ``clip`` counts negative predictions as zero."""
    scored = model.transform(test).withColumn("prediction", _clipped("prediction", clip))
    return regression_metrics(scored, "label", "prediction")


def finalise(kind: str, train: DataFrame, test: DataFrame, params: Mapping | None = None, seed: int = 42,
             categories: int = 0):
    """Fit on the train rows, boosting with early stopping; the model and its metrics with the seconds of fitting.

    A forest without category indexes is grown by ``forest.grow``, which takes its full size.
    """
    begin = time.perf_counter()
    if kind == "rf" and not categories:
        model = forest.grow(train, {**DEFAULTS["rf"], **(params or {})}, seed, _bins(categories))
    else:
        model = fit(kind, train, params, early_stopping=True, seed=seed, categories=categories)
    spent = time.perf_counter() - begin
    return model, evaluate(model, test).withColumn("train_time", F.lit(spent))


def _cross_validate(kind: str, train: DataFrame, choices: Sequence[dict], folds: int, seed: int, parallelism: int,
                    categories: int):
    """Mean absolute error of every choice over the folds; boosting stops early on a part of each fold's train rows."""
    judge = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mae")
    # Every fit passes over its folds several times; hashes and vectors are made once.
    parts = materialise(with_fold(train, folds, seed).select("job_id", "features", "label", "fold"))

    def error(task: tuple[int, int]) -> float:
        choice, fold = task
        model = fit(kind, parts.where(F.col("fold") != fold), choices[choice], early_stopping=True, seed=seed + fold,
                    categories=categories, holdout=CV_HOLDOUT, patience=CV_PATIENCE)
        return judge.evaluate(model.transform(parts.where(F.col("fold") == fold)))

    tasks = [(c, f) for c in range(len(choices)) for f in range(folds)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        errors = pool.map(inheritable_thread_target(train.sparkSession)(error), tasks)
    means = [sum(e for (c, _), e in zip(tasks, errors) if c == i) / folds for i in range(len(choices))]
    ranked = sorted(zip(means, choices, strict=True), key=lambda pair: pair[0])
    table = train.sparkSession.createDataFrame(
        [(json.dumps(choice, sort_keys=True), float(mae), i + 1) for i, (mae, choice) in enumerate(ranked)],
        "params string, cv_mae double, rank int")
    return ranked[0][1], table


def _combinations(space: Mapping[str, Sequence]) -> list[dict]:
    names = sorted(space)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*[space[n] for n in names])]


def grid_search(kind: str, train: DataFrame, space: Mapping[str, Sequence], folds: int = 3, seed: int = 42,
                parallelism: int = 4, categories: int = 0):
    """Best parameters by cross-validated MAE over the whole space, and the table of all."""
    return _cross_validate(kind, train, _combinations(space), folds, seed, parallelism, categories)


def random_search(kind: str, train: DataFrame, space: Mapping[str, Sequence] | None = None, n_iter: int = 10,
                  folds: int = 3, seed: int = 42, parallelism: int = 4, categories: int = 0):
    """Like ``grid_search`` over ``n_iter`` combinations drawn without repetition."""
    every = _combinations(space or SPACES[kind])
    drawn = random.Random(seed).sample(every, min(n_iter, len(every)))
    return _cross_validate(kind, train, drawn, folds, seed, parallelism, categories)


def feature_names(assembled: DataFrame) -> list[str]:
    """Names of the ``features`` entries; a one-hot entry is ``<column>_<category>``."""
    attrs = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    entries = [a for group in attrs.values() for a in group]
    return [re.sub(r"^(\w+?)_vector_", r"\1_", a["name"]) for a in sorted(entries, key=lambda a: a["idx"])]


def feature_importance(model, assembled: DataFrame, top: int | None = 10, names: DataFrame | None = None) -> DataFrame:
    """Importance per feature, largest first; ``names`` (``feature, name``) renames one-hot entries."""
    rows = [(name, float(weight)) for name, weight in
            zip(feature_names(assembled), model.featureImportances.toArray(), strict=True)]
    table = assembled.sparkSession.createDataFrame(rows, "feature string, importance double")
    if names is not None:
        table = table.join(names, "feature", "left").select(F.coalesce("name", "feature").alias("feature"), "importance")
    table = table.orderBy(F.desc("importance"), "feature")
    return table.limit(top) if top else table


def score(df: DataFrame, models: Mapping[str, object], clip: bool = False) -> DataFrame:
    """Add one ``pred_<name>`` column per model; other columns stay."""
    kept = df.columns
    for name, model in models.items():
        scored = model.copy({model.getParam("predictionCol"): f"pred_{name}"}).transform(df)
        df = scored.withColumn(f"pred_{name}", _clipped(f"pred_{name}", clip))
    return df.select(*kept, *[f"pred_{name}" for name in models])


def experiment_record(spark: SparkSession, name: str, metrics: DataFrame, params: Mapping) -> DataFrame:
    """One experiment in the shape the experiment writer takes."""
    settings = F.create_map(*[x for k in sorted(params) for x in (F.lit(k), F.lit(str(params[k])))]) \
        if params else F.lit(None).cast("map<string,string>")
    return metrics.select(F.lit(name).alias("experiment"), F.struct(
        "mae", "rmse", "r2", "mape", "mdae", "train_time").alias("metrics"), settings.alias("best_params"))


def save_model(model, path: str) -> None:
    if isinstance(model, forest.Forest):
        model = model.spark_model()
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path).stages[0]
