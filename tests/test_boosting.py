"""Median leaves, patience, ordered categories and exact signed ranks against plain computations."""

import itertools
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from jobtrail.operators import boosting, features, ml, policy
from jobtrail.plans import catalog


def rows_of(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 3)), i % 5 == 0) for i in range(n)]
    labelled = [(i, a, b, v, 3 * a - 5 * b + rng.choice([0.0, 0.5, 40.0])) for i, a, b, v in rows]
    frame = spark.createDataFrame(labelled, "job_id long, a double, b double, is_val boolean, label double").repartition(3)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame)


@pytest.mark.parametrize("ranked_rows", [1 << 20, 40, 1])
def test_group_medians(spark, ranked_rows):
    rng = random.Random(1)
    values = [(g, v) for g in range(4) for v in [rng.uniform(-9, 9) for _ in range(201 + g)]]
    values += [(4, 2.5)] * 300 + [(5, float(v)) for v in [1] * 150 + [2] * 150] + [(6, 7.0), (7, -1.0), (7, 4.0)]
    frame = spark.createDataFrame([*values, (None, 1.0), (6, None), (8, None)], "g int, v double").repartition(3)
    got = boosting.group_medians(frame, "v", "g", ranked_rows, 100) if ranked_rows > 1 else \
        boosting.group_medians(frame.where("g >= 4"), "v", "g", 200, 1000)
    want = {g: statistics.median(v for h, v in values if h == g) for g in {g for g, _ in values}}
    assert got == pytest.approx({g: m for g, m in want.items() if g in got})
    assert set(got) == (set(want) if ranked_rows > 1 else {4, 5, 6, 7})
    assert boosting.group_medians(frame.limit(0), "v", "g") == {}


def test_leaves_are_medians_of_the_residuals(spark):
    rows = rows_of(spark)
    found = boosting.boost(rows, "absolute", {"maxIter": 1, "maxDepth": 2, "stepSize": 1.0})
    table = found.model.transform(rows).select("label", "prediction").toPandas()
    base = table.label.median()
    groups = table.groupby(table.prediction.round(9))
    assert 2 <= len(groups) <= 4
    for prediction, group in groups:
        assert prediction == pytest.approx(base + (group.label - base).median())
    # Medians are at least as close to the labels as the means Spark's own trees would keep.
    assert (table.label - table.prediction).abs().mean() <= (table.label - base).abs().mean()


@pytest.mark.parametrize("loss", boosting.LOSSES)
def test_patience_cuts_back_to_the_best_round(spark, loss, tmp_path):
    rows = rows_of(spark)
    found = boosting.boost(rows, loss, {"maxIter": 30, "maxDepth": 3, "stepSize": 0.7}, "is_val", patience=4)
    best = int(np.argmin(found.errors)) + 1
    assert found.best_round == best
    assert len(found.errors) == min(30, best + 4)
    assert found.model.getNumTrees == best + 1  # the first tree is the constant
    staged = found.model.evaluateEachIteration(rows.where("is_val"), "absolute")
    assert staged[1:] == pytest.approx(found.errors[:best])
    assert min(found.errors) < staged[0]
    found.model.save(str(tmp_path / "m"))
    again = GBTRegressionModel.load(str(tmp_path / "m"))
    assert again.transform(rows).select("prediction").collect() == found.model.transform(rows).select("prediction").collect()
    assert found.model.featureImportances.toArray().sum() == pytest.approx(1)
    table = boosting.rounds_table(spark, found).collect()
    assert [r.round for r in table if r.best] == [best]


def test_odd_training_rows(spark):
    rows = rows_of(spark, 50)
    constant = boosting.boost(rows.withColumn("label", F.lit(4.0)), "absolute", {"maxIter": 2})
    assert {r.prediction for r in constant.model.transform(rows).collect()} == {4.0}
    some = rows.withColumn("label", F.when(F.col("job_id") % 2 == 0, F.col("label")))
    assert boosting.boost(some, "squared", {"maxIter": 1}).model.transform(rows).count() == 50
    no_val = boosting.boost(rows.withColumn("none", F.lit(None).cast("boolean")), "absolute", {"maxIter": 2}, "none", 1)
    assert no_val.errors == [None, None] and no_val.best_round == 2
    with pytest.raises(ValueError):
        boosting.boost(rows.limit(0), "absolute")
    with pytest.raises(ValueError):
        boosting.boost(rows, "absolute", patience=3)


def test_fit_uses_median_leaves_and_patience(spark):
    rows = rows_of(spark).drop("is_val")
    model = ml.fit("gbt_l1", rows, {"maxIter": 4, "minInstancesPerNode": 5}, early_stopping=True, patience=2)
    assert isinstance(model, GBTRegressionModel) and model.getLossType() == "absolute" and model.getNumTrees <= 5


def test_spark_boosting_is_cut_back(spark):
    rows = rows_of(spark)
    held = rows.where("is_val")
    whole = ml.estimator("gbt", {"maxIter": 12, "maxDepth": 4, "stepSize": 0.9, "subsamplingRate": 0.5}).fit(rows.where("NOT is_val"))
    errors = whole.evaluateEachIteration(held, "absolute")
    found = boosting.stopped(whole, held, 3)
    best, last = boosting.best_round(errors, 3)
    assert best == int(np.argmin(errors[:last])) + 1 and last in (12, best + 3)
    assert found.model.getNumTrees == found.best_round == best and found.errors == pytest.approx(errors[:last])
    assert found.model.evaluateEachIteration(held, "absolute") == pytest.approx(errors[:best])
    cut = boosting.cut_back(whole, 5)
    assert cut.getNumTrees == 5 and cut.treeWeights == whole.treeWeights[:5]
    assert boosting.best_round([3.0, 1.0, 1.0, 2.0, 0.5], 2) == (2, 4)
    assert boosting.best_round([3.0, 1.0, 1.0, 2.0, 0.5], None) == (5, 5)
    fitted = ml.fit_boosted("gbt", rows.drop("is_val"), {"maxIter": 4, "maxDepth": 2}, patience=2)
    assert fitted.model.getNumTrees == fitted.best_round <= 4


CODED = [(0, "a", 10.0, "train"), (1, "a", 30.0, "train"), (2, "b", 7.0, "train"), (3, "a", 99.0, "test"), (4, "new", 1.0, "test"),
         (5, None, 5.0, "train"), (6, None, 6.0, "test"), (7, "b", None, "train"), (8, "b", 2.0, None)]


@pytest.mark.parametrize("mode", ["numeric_only", "with_categorical_ordered"])
def test_learners_get_as_many_parts_as_cores(spark, small, mode):
    inputs = catalog._inputs(spark, small, mode)
    assert inputs.assembled.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_target_codes(spark):
    frame = spark.createDataFrame([(*r, 1.0) for r in CODED], "job_id long, user string, label double, split string, _sum double")
    got = {r.job_id: r.user_code for r in features.target_codes(frame, ["user"], smoothing=2.0).collect()}
    learnt = [(u, y) for _, u, y, s in CODED if s == "train" and y is not None]
    mean = sum(y for _, y in learnt) / len(learnt)
    for job, user, y, split in CODED:
        own = [v for u, v in learnt if u == user]
        if split == "train" and y is not None:
            own.remove(y)
        assert got[job] == pytest.approx((sum(own) + 2 * mean) / (len(own) + 2)), job


def test_many_categories_need_no_more_bins(spark):
    n = 200_000
    frame = spark.range(n).select(F.col("id").alias("job_id"), F.concat(F.lit("u"), F.col("id") % (n // 2)).alias("user"),
                                  (F.col("id") % 7).cast("double").alias("num"), F.lit("train").alias("split"),
                                  ((F.col("id") % (n // 2)) % 100).cast("double").alias("label"))
    inputs, categories = features.assemble(frame, frame, ["num"], ["user"], "with_categorical_ordered")
    model = ml.fit("rf", inputs, {"numTrees": 1, "maxDepth": 4, "bootstrap": False, "featureSubsetStrategy": "all"}, categories=categories)
    assert categories == 0 and model.getMaxBins() == 32
    # Each user's other row has the same label, so the code orders the users well.
    assert ml.evaluate(model, inputs).first().mae < 5


def by_enumeration(diffs):
    kept = [d for d in diffs if d]
    size = sorted(map(abs, kept))
    rank = {m: np.mean([i + 1 for i, x in enumerate(size) if x == m]) for m in size}
    w = sum(rank[abs(d)] for d in kept if d > 0)
    ranks = [rank[abs(d)] for d in kept]
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(ranks))]
    return len(kept), w, sum(s >= w - 1e-9 for s in sums) / len(sums)


def test_signed_ranks_are_exact_for_few_pairs(spark):
    rng = random.Random(4)
    groups = {f"g{i}": [rng.randint(-4, 6) for _ in range(rng.randint(0, 11))] or [0] for i in range(12)}
    groups |= {"zero": [0, 0], "plus": [1, 2, 3], "minus": [-1, -2, -3], "one": [5], None: [3, 3, -3]}
    frame = spark.createDataFrame([(g, d) for g, ds in groups.items() for d in [*ds, None]], "policy string, diff long")
    got = {r.policy: r for r in policy.signed_rank_test(frame).collect()}
    assert len(got) == len(groups)
    for name, diffs in groups.items():
        n, w, p = by_enumeration(diffs)
        assert (got[name].n, got[name].w_plus, got[name].exact) == (n, w, True), name
        assert got[name].p_value == pytest.approx(p if n else 1.0), name


def test_exact_tails_of_many_groups(spark):
    """Counting takes pairs times rank sum per group; 300 groups of 50 pairs are done in seconds."""
    rows = spark.range(300 * 50).selectExpr("concat('g', id % 300) AS policy", "if(id % 7 = 0, -1, 1) * (id div 300 + 1) AS diff")
    begin = time.perf_counter()
    found = policy.signed_rank_test(rows).collect()
    assert time.perf_counter() - begin < 30
    assert len(found) == 300 and all(r.n == 50 and r.exact for r in found)
    ways = [1] + [0] * 1275
    for rank in range(1, 51):
        ways = [w + (ways[s - rank] if s >= rank else 0) for s, w in enumerate(ways)]
    assert all(r.p_value == sum(ways[int(r.w_plus):]) / 2 ** 50 for r in found)


def test_exact_and_approximate_tails_meet(spark):
    rng = random.Random(8)
    frame = spark.createDataFrame([("p", rng.randint(-80, 100)) for _ in range(50)], "policy string, diff long")
    exact, near = (policy.signed_rank_test(frame, exact_pairs=k).first() for k in (50, 10))
    assert exact.exact and not near.exact
    assert exact.p_value == pytest.approx(near.p_value, abs=0.01)
