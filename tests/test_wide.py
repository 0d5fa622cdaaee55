"""Trees over many categories against Spark's own trees, and boosting on them."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from jobtrail.operators import boosting, features, ml, wide

ONE = {"maxDepth": 4, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}


def coded(spark, mode, users=130, n=1500):
    rng = random.Random(11)
    effect = [rng.uniform(-30, 30) for _ in range(users)]
    rows = [(i, f"u{u}", float(rng.randint(0, 12)), rng.uniform(-1, 1)) for i in range(n) for u in [min(rng.randrange(users), rng.randrange(users))]]
    labelled = [(i, u, a, b, effect[int(u[1:])] + 5 * a - 9 * (b > 0) + rng.random()) for i, u, a, b in rows]
    frame = spark.createDataFrame(labelled, "job_id long, user string, a double, b double, label double").repartition(3)
    return features.assemble(frame.withColumn("split", F.lit("train")), frame, ["a", "b"], ["user"], mode)


def close(model, other, rows, column="prediction"):
    got, want = ([r[0] for r in m.transform(rows).orderBy("job_id").select(c).collect()] for m, c in ((model, column), (other, "prediction")))
    assert len(set(want)) > 8
    assert got == pytest.approx(want)


@pytest.mark.parametrize("mode", ["with_categorical_onehot", "with_categorical_native"])
def test_a_tree_is_sparks_tree(spark, mode):
    # Few values of b, so that Spark's bins are the same whatever it samples.
    rows, categories = coded(spark, mode)
    bins = max(32, categories) if mode == "with_categorical_native" else 32
    rows = rows.withColumn("job_id", F.col("job_id"))
    learner = wide.learner(rows, bins)
    exact = wide.Learner(learner.inputs, learner.cuts)
    tree = exact.fit(exact.prepare(rows), "label", ONE, 3)
    spark_tree = RandomForestRegressor(numTrees=1, bootstrap=False, maxBins=bins, **ONE).fit(rows)
    got, want = (m.transform(rows).select(F.col(c).alias("p"), "label") for m, c in ((tree, "guess"), (spark_tree, "prediction")))
    errors = [r.agg(F.avg((F.col("p") - F.col("label")) ** 2)).first()[0] for r in (got, want)]
    # The ends of the bins of b may differ by a value.
    assert errors[0] == pytest.approx(errors[1], rel=0.02)


@pytest.mark.parametrize("mode", ["with_categorical_onehot", "with_categorical_native"])
def test_boosting_is_sparks_boosting(spark, mode):
    """On inputs of few values both have the same cuts, so the whole boosted models agree."""
    rows, categories = coded(spark, mode)
    plain = rows.withColumn("b", F.signum("b")).drop("features", "user_index", "user_vector")
    rows, categories = features.assemble(plain, plain, ["a", "b"], ["user"], mode)
    bins = max(32, categories) if mode == "with_categorical_native" else 32
    learner, settings = wide.learner(rows, bins), {"maxIter": 3, "stepSize": 0.3, **ONE}
    model = boosting.boost_wide(rows, learner, settings, 42, bins)
    assert isinstance(model, GBTRegressionModel) and model.getNumTrees == 3
    close(model, GBTRegressor(maxBins=bins, seed=42, **settings).fit(rows), rows)


def test_fit_takes_wide_inputs(spark, monkeypatch):
    """Spark's trees would hold every one-hot entry of every row; they are not used for such inputs."""
    def never(*_):
        raise AssertionError("Spark's trees were used.")

    monkeypatch.setattr(RandomForestRegressor, "fit", never)
    monkeypatch.setattr(GBTRegressor, "fit", never)
    rows, _ = coded(spark, "with_categorical_onehot")
    assert ml.fit("gbt", rows, {"maxIter": 3, "maxDepth": 3}, early_stopping=True).getNumTrees <= 3
    rows, categories = coded(spark, "with_categorical_native")
    assert ml.fit("gbt_l1", rows, {"maxIter": 2, "maxDepth": 3}, categories=categories).getNumTrees == 3


def test_vectors_as_text():
    row, at, value = wide._sparse(["(9,[0,8],[1.5,1.0])", "(9,[],[])", "[0.0,-2.0E-7]", "(9,[3],[4.0])"])
    assert row.tolist() == [0, 0, 2, 2, 3] and at.tolist() == [0, 8, 0, 1, 3]
    assert value.tolist() == [1.5, 1.0, 0.0, -2e-7, 4.0]


def test_more_bins_than_256(spark):
    frame = spark.range(3000).select(F.col("id").alias("job_id"), (F.col("id") * 37 % 3000 / 7).alias("v"), F.lit("x").alias("user"),
                                     F.lit(1.0).alias("label"))
    rows, _ = features.assemble(frame, frame, ["v"], ["user"], "with_categorical_native")
    cuts = wide.cuts_of(rows, wide.inputs_of(rows), 500)[0]
    counts = np.bincount(np.searchsorted(cuts, np.arange(3000) / 7))
    assert len(cuts) == 499 and counts.min() >= 5 and counts.max() <= 7
    assert len(wide.cuts_of(rows, wide.inputs_of(rows), 3001)[0]) == 2999
