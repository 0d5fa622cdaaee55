"""Forests against Spark's own tree, and the same forest however rows are dealt and trees are cut."""

import random
import time

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from jobtrail.operators import forest, ml
from jobtrail.plans import catalog


def rows_of(spark, n=500, seed=5):
    rng = random.Random(seed)
    rows = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 20)), float(rng.randint(0, 3))) for i in range(n)]
    labelled = [(*r, 3 * r[1] - 5 * r[3] + (r[2] > 8) * 20 + rng.random()) for r in rows]
    frame = spark.createDataFrame(labelled, "job_id long, a double, b double, c double, label double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)


def predictions(model, rows):
    return [r.prediction for r in model.transform(rows).orderBy("job_id").select("prediction").collect()]


@pytest.mark.parametrize("leaf_rows", [1, 20])
def test_a_tree_is_sparks_tree(spark, leaf_rows):
    rows = rows_of(spark)
    one = {"numTrees": 1, "maxDepth": 5, "bootstrap": False, "featureSubsetStrategy": "all", "minInstancesPerNode": leaf_rows}
    want = predictions(ml.fit("rf", rows, one), rows)
    for group_rows in (1 << 18, 60):
        assert predictions(forest.grow(rows, one, group_rows=group_rows), rows) == pytest.approx(want)


def test_forest_is_the_same_however_it_is_cut(spark):
    """Spark draws rows and inputs by part and by step; here another dealing gives the same forest."""
    rows = rows_of(spark)
    params = {"numTrees": 7, "maxDepth": 6, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.8}
    want = predictions(forest.grow(rows, params), rows)
    assert len(set(want)) > 100
    for given in (rows, rows.repartition(11), rows.repartition(1)):
        for group_rows, wave_rows in ((1 << 18, 1 << 28), (50, 1000), (1, 1)):
            if (given is rows) != (group_rows == 1 << 18):
                got = forest.grow(given, params, group_rows=group_rows, wave_rows=wave_rows)
                assert predictions(got, rows) == pytest.approx(want)
    assert predictions(forest.grow(rows, params, seed=7), rows) != pytest.approx(want)


def test_drawn_rows_have_the_poisson_shares(spark):
    import numpy as np

    shape = forest.Shape(3, 32, 2, 4, 1, 1.0, 42)
    w = shape.weights(np.arange(100_000, dtype=np.uint64), 3)
    assert w.mean() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (w != shape.weights(np.arange(100_000, dtype=np.uint64), 4)).any()
    drawn = shape.subset(0, np.arange(1, 30_001))
    assert np.bincount(drawn.ravel()) / 30_000 == pytest.approx(2 / 3, abs=0.02)


def test_spark_model_of_a_forest(spark, tmp_path):
    rows = rows_of(spark)
    grown = forest.grow(rows, {"numTrees": 5, "maxDepth": 4})
    model = grown.spark_model()
    assert predictions(model, rows) == predictions(grown, rows) and model.getNumTrees == 5
    assert model.featureImportances.toArray().sum() == pytest.approx(1)
    ml.save_model(grown, str(tmp_path / "m"))
    assert predictions(ml.load_model(str(tmp_path / "m")), rows) == predictions(grown, rows)


def test_odd_rows(spark):
    rows = rows_of(spark, 40)
    flat = forest.grow(rows.withColumn("label", F.lit(4.1)), {"numTrees": 3})
    assert predictions(flat, rows) == pytest.approx([4.1] * 40)
    some = rows.withColumn("label", F.when(F.col("job_id") % 2 == 0, F.col("label")))
    assert len(predictions(forest.grow(some, {"numTrees": 2, "maxDepth": 0}), rows)) == 40
    with pytest.raises(ValueError):
        forest.grow(rows.limit(0))


def test_full_forest_is_whole_and_quick(spark, small):
    """All 150 trees of depth 15; Spark's forest took most of a minute on a table of this size."""
    inputs = catalog._inputs(spark, small, "with_categorical_ordered")
    copies = inputs.train.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumn("job_id", F.col("job_id") * 10 + F.col("copy"))
    begin = time.perf_counter()
    model, table = ml.finalise("rf", copies, inputs.test)
    assert table.first().mae > 0
    assert time.perf_counter() - begin < 40
    assert model.trees == 150 and model.parts.select("tree").distinct().count() == 150
