"""Boosting in one task against Spark's own boosting and the rounds that Spark jobs take, and the sizes the queries ask for."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from jobtrail.operators import boosting, features, ml, rounds, wide
from jobtrail.plans import catalog

MODES = ["with_categorical_onehot", "with_categorical_native"]
ONE = {"maxDepth": 4, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}


def coded(spark, mode, users=40, n=900):
    rng = random.Random(11)
    effect = [rng.uniform(-30, 30) for _ in range(users)]
    rows = [(i, f"u{u}", float(rng.randint(0, 12)), float(rng.randint(0, 1))) for i in range(n) for u in [min(rng.randrange(users), rng.randrange(users))]]
    labelled = [(i, u, a, b, effect[int(u[1:])] + 5 * a - 9 * b + rng.random(), i % 5 == 0) for i, u, a, b in rows]
    frame = spark.createDataFrame(labelled, "job_id long, user string, a double, b double, label double, is_val boolean").repartition(3)
    return features.assemble(frame.withColumn("split", F.lit("train")), frame, ["a", "b"], ["user"], mode)


def predictions(model, rows):
    return [r.prediction for r in model.transform(rows).orderBy("job_id").select("prediction").collect()]


@pytest.mark.parametrize("query, kind", [(catalog.gbt_metrics, "gbt"), (catalog.gbt_l1_metrics, "gbt_l1")])
def test_queries_fit_the_full_size(monkeypatch, query, kind):
    seen = []
    monkeypatch.setattr(catalog, "_inputs", lambda *_: SimpleNamespace(train=None, test=None, categories=7))
    monkeypatch.setattr(ml, "evaluate", lambda *_: None)
    monkeypatch.setattr(ml, "fit", lambda kind, train, params=None, **_: seen.append((kind, {**ml.DEFAULTS[kind], **(params or {})})))
    query(None, None)
    assert seen == [(kind, ml.DEFAULTS[kind])]


@pytest.mark.parametrize("mode", MODES)
def test_squared_error_is_sparks_boosting(spark, mode):
    rows, categories = coded(spark, mode)
    bins, settings = max(32, categories), {"maxIter": 3, "stepSize": 0.3, **ONE}
    found = boosting.boost_in_memory(rows, "squared", settings, max_bins=bins)
    want = predictions(GBTRegressor(maxBins=bins, seed=42, **settings).fit(rows), rows)
    assert len(set(want)) > 8
    assert predictions(found.model, rows) == pytest.approx(want)
    assert found.model.getNumTrees == found.best_round == 3 and found.errors == []


def test_absolute_error_is_that_of_spark_jobs(spark):
    rows, _ = coded(spark, "with_categorical_native", users=130)
    settings = {"maxIter": 2, "stepSize": 0.7, **ONE}
    want = boosting.boost(rows, "absolute", settings, "is_val", 2, max_bins=130)
    found = boosting.boost_in_memory(rows, "absolute", settings, "is_val", 2, max_bins=130)
    assert found.errors == pytest.approx(want.errors) and found.best_round == want.best_round
    assert predictions(found.model, rows) == pytest.approx(predictions(want.model, rows))


@pytest.mark.parametrize("loss", boosting.LOSSES)
def test_patience_and_dealing(spark, loss):
    rows, _ = coded(spark, "with_categorical_onehot")
    settings = {"maxIter": 40, "maxDepth": 3, "stepSize": 0.9, "subsamplingRate": 0.6, "featureSubsetStrategy": "0.5"}
    found = boosting.boost_in_memory(rows, loss, settings, "is_val", 3)
    best = int(np.argmin(found.errors)) + 1
    assert found.best_round == best and len(found.errors) == min(40, best + 3)
    staged = found.model.evaluateEachIteration(rows.where("is_val"), "absolute")
    assert staged[int(loss == "absolute"):] == pytest.approx(found.errors[:best])
    again = boosting.boost_in_memory(rows.repartition(7), loss, settings, "is_val", 3)
    assert again.errors == found.errors and predictions(again.model, rows) == predictions(found.model, rows)


def test_odd_rows(spark):
    rows, _ = coded(spark, "with_categorical_onehot")
    odd = rows.withColumn("label", F.when(F.col("job_id") % 2 == 0, F.lit(4.0))).withColumn("none", F.lit(None).cast("boolean"))
    flat = boosting.boost_in_memory(odd, "absolute", {"maxIter": 2}, "none", 1)
    assert set(predictions(flat.model, rows)) == {4.0} and flat.errors == [] and flat.best_round == 2
    with pytest.raises(ValueError):
        boosting.boost_in_memory(rows.limit(0), "absolute", {})
    assert boosting.boost_in_memory(rows.select("label", F.col("features").alias("features", metadata={})), "squared", {}) is None


def test_many_rounds_are_quick(spark):
    """As Spark jobs, a round took more than a second."""
    rows, categories = coded(spark, "with_categorical_native")
    begin = time.perf_counter()
    model = ml.fit("gbt_l1", rows, {"maxIter": 300}, categories=categories)
    assert model.getNumTrees == 301 and time.perf_counter() - begin < 120


def test_cells_of_many_bins():
    rng = np.random.default_rng(1)
    place, y = rng.integers(0, 1 << 20, 5000), rng.integers(-3, 4, 5000).astype(float)
    key, count, total = rounds._cells(place, y, 1 << 20)
    counts, sums = np.bincount(place, minlength=1 << 20), np.bincount(place, y, 1 << 20)
    assert key.tolist() == np.flatnonzero(counts).tolist()
    assert count.tolist() == counts[key].tolist() and total.tolist() == sums[key].tolist()


def test_rows_beyond_one_task_are_boosted_by_spark_jobs(spark, monkeypatch):
    rows, _ = coded(spark, "with_categorical_onehot")
    assert not rounds.fits(wide.inputs_of(rows), rounds.LOCAL_ROWS + 1, {"maxDepth": 3})
    monkeypatch.setattr(rounds, "LOCAL_ROWS", 10)
    assert boosting.boost_in_memory(rows, "squared", {"maxIter": 1, "stepSize": 0.1}) is None
