"""Boosted trees with median leaves and stopping by patience, as Spark models.

Each round fits one Spark tree to the gradient of the loss on the rows' current
margins. With absolute loss the gradient is a sign, and a mean of signs says
nothing about how far the labels are, so every leaf gets the median of its rows'
residuals instead, found by distributed selection. The held-out error is taken
after each round; boosting ends when it has not improved for ``patience`` rounds,
and the model is cut back to the best one.

The result is a ``GBTRegressionModel``: the trees are written in Spark's own
model format, the node table gets the leaf values by a join, and the whole is
loaded again, so scoring, importances and saving are Spark's. Margins are cut
from their lineage every ``CUT`` rounds (with median leaves: every round) in the shared
checkpoint folder: a round passes over the rows several times, and each pass adds up the
trees since the last cut. Only
leaf values (2**depth per tree) and one error per round come to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.util import inheritable_thread_target

from jobtrail.operators import rounds, wide
from jobtrail.operators.checkpoints import fresh_path, materialise
from jobtrail.operators.quantiles import quantiles

CUT = 2
# A group with more rows than this is narrowed to a bracket around its median first.
RANKED_ROWS = 1 << 20
ACCURACY = 5_000
LOSSES = ("squared", "absolute")


@dataclass(frozen=True)
class Boosted:
    """A model, its held-out mean absolute error after each round (from round 1), and the round it was cut back to."""

    model: GBTRegressionModel
    errors: list[float]
    best_round: int


def group_medians(rows: DataFrame, value: str, by: str, ranked_rows: int = RANKED_ROWS, accuracy: int = ACCURACY) -> dict:
    """Exact median per group (mean of the two middle values); groups must be few, their rows may be any number.

    Rows are counted per distinct value before they are ranked. Groups of more
    than ``ranked_rows`` rows are first narrowed: approximate percentiles, whose
    rank error is bounded, give a bracket around the median, the rows below it
    are counted, and the next round looks at the bracket only. Null values and
    groups are left out.
    """
    rows = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    sizes = {r["g"]: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                                      F.max("v").alias("hi")).collect()}
    brackets = {g: (r["lo"], r["hi"], 0, r["n"]) for g, r in sizes.items()}
    spark, tied = rows.sparkSession, set()

    def inside(wide: Mapping) -> DataFrame:
        table = spark.createDataFrame([(g, *b) for g, b in wide.items()],
                                      rows.select("g").schema.add("lo", "double").add("hi", "double")
                                      .add("below", "long").add("inside", "long"))
        return rows.join(F.broadcast(table), "g")

    while True:
        wide = {g: b for g, b in brackets.items() if b[3] > ranked_rows and b[0] < b[1] and g not in tied}
        if not wide:
            break
        kept = inside(wide).where("v BETWEEN lo AND hi")
        # The two middle ranks as shares of the bracket, moved outwards by more than the sketch's error.
        share = {g: (max(0.0, ((sizes[g]["n"] - 1) // 2 - b[2]) / b[3] - 2 / accuracy),
                     min(1.0, (sizes[g]["n"] // 2 + 1 - b[2]) / b[3] + 2 / accuracy)) for g, b in wide.items()}
        grid = sorted({p for pair in share.values() for p in pair})
        sketched = kept.groupBy("g").agg(F.percentile_approx("v", grid, accuracy).alias("p")).collect()
        found = {r["g"]: (r["p"][grid.index(share[r["g"]][0])], r["p"][grid.index(share[r["g"]][1])]) for r in sketched}
        narrowed = inside({g: (*found[g], 0, 0) for g in wide}).groupBy("g").agg(
            F.count_if(F.expr("v < lo")).alias("below"), F.count_if(F.expr("v BETWEEN lo AND hi")).alias("inside")).collect()
        for r in narrowed:
            n, old = sizes[r["g"]]["n"], brackets[r["g"]]
            if not (r["below"] <= (n - 1) // 2 and n // 2 < r["below"] + r["inside"]):
                raise ArithmeticError(f"The median of group {r['g']} is outside its bracket; raise the accuracy.")
            brackets[r["g"]] = (*found[r["g"]], r["below"], r["inside"])
            if r["inside"] >= old[3]:
                # Only values that many rows share keep a bracket from narrowing, and those are counted as one.
                tied.add(r["g"])
    out = {g: b[0] for g, b in brackets.items() if b[0] == b[1]}
    rest = {g: b for g, b in brackets.items() if g not in out}
    if rest:
        counted = inside(rest).where("v BETWEEN lo AND hi").groupBy("g", "v", "below").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("upto", F.col("below") + F.sum("c").over(upto)).withColumn("before", F.col("upto") - F.col("c"))
        total = spark.createDataFrame([(g, sizes[g]["n"]) for g in rest], rows.select("g").schema.add("n", "long"))
        middle = [F.max(F.when((F.col("before") <= k) & (k < F.col("upto")), F.col("v")))
                  for k in (F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))]
        for r in ranked.join(F.broadcast(total), "g").groupBy("g").agg((middle[0] / 2 + middle[1] / 2).alias("m")).collect():
            out[r["g"]] = r["m"]
    return out


def _ensemble(spark: SparkSession, trees: Sequence, values: Sequence[Mapping[int, float] | None], base: float | None,
              rows: int, settings: Mapping) -> GBTRegressionModel:
    """The trees with their leaf values, behind a first tree of one leaf that predicts ``base`` (None: without it)."""
    folder, shift = fresh_path(spark, "boosted"), int(base is not None)

    def save(i: int) -> None:
        trees[i].save(f"{folder}/tree-{i + shift}")

    with ThreadPool(8) as pool:
        pool.map(inheritable_thread_target(spark)(save), range(len(trees)))
    stored = spark.read.parquet(f"{folder}/tree-*/data")
    number = F.regexp_extract("_metadata.file_path", r"/tree-(\d+)/data/", 1).cast("int")
    nodes = stored.select(number.alias("treeID"), "nodeData")
    is_leaf = F.col("nodeData.leftChild") < 0
    upto = Window.partitionBy("treeID").orderBy("nodeData.id").rowsBetween(Window.unboundedPreceding, 0)
    leaf = F.when(is_leaf, F.count_if(is_leaf).over(upto) - 1)
    given = [(i + shift, leaf_no, float(v)) for i, own in enumerate(values) if own for leaf_no, v in own.items()]
    table = spark.createDataFrame(given, "treeID int, leaf long, value double")
    known = nodes.withColumn("leaf", leaf).join(F.broadcast(table), ["treeID", "leaf"], "left")
    node = F.col("nodeData").withField("prediction", F.coalesce("value", "nodeData.prediction"))
    first = [(0, (0, base, 0.0, [float(rows), base * rows, 0.0], rows, -1.0, -1, -1, (-1, [], -1)))] if shift else []
    every = spark.createDataFrame(first, nodes.schema).unionByName(known.select("treeID", node.alias("nodeData")))
    every.coalesce(1).write.parquet(f"{folder}/model/data")

    own = spark.read.parquet(f"{folder}/tree-1/treesMetadata").first()[1]
    named = [(i, json.dumps(json.loads(own) | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0 if i == 0 else settings["stepSize"])
             for i in range(len(trees) + shift)]
    spark.createDataFrame(named, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/model/treesMetadata")
    GBTRegressor(**settings).save(f"{folder}/estimator")
    described = json.loads(spark.read.text(f"{folder}/estimator/metadata").first()[0])
    described |= {"class": "org.apache.spark.ml.regression.GBTRegressionModel", "numFeatures": trees[0].numFeatures,
                  "numTrees": len(trees) + shift}
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{folder}/model/metadata")
    return GBTRegressionModel.load(f"{folder}/model")


def boost(train: DataFrame, loss: str = "absolute", params: Mapping | None = None, validation: str | None = None,
          patience: int | None = None, seed: int = 42, max_bins: int = 32) -> Boosted:
    """Boost trees on ``features, label``; rows whose ``validation`` column is true are held out.

    ``params`` are those of Spark's gradient-boosted trees (``maxIter``, ``stepSize``, ``maxDepth``,
    ``minInstancesPerNode``, ``subsamplingRate``, ``featureSubsetStrategy``). With validation rows the
    model has the trees up to the round of the smallest held-out mean absolute error (the first one, at
    ties); with ``patience``, boosting stops once that many rounds have brought nothing better. Rows
    without a label are left out; without any training row there is no model.
    """
    if loss not in LOSSES:
        raise ValueError(f"Unknown loss: {loss!r}")
    if patience is not None and validation is None:
        raise ValueError("Patience needs held-out rows.")
    settings = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, **(params or {})}
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    rows = train.select("features", F.col("label").cast("double").alias("label"), held.alias("held")).where("label IS NOT NULL")
    rows = materialise(rows)
    own_learner = wide.learner(rows.where("NOT held"), max_bins)
    if own_learner is not None:
        rows = materialise(own_learner.prepare(rows))
    kept_columns = [*rows.columns, "margin"]
    fitted = rows.where("NOT held")
    start = fitted.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
    if not start["n"]:
        raise ValueError("There is no training row with a label.")
    base = start["mean"] if loss == "squared" else quantiles(fitted, "label", {"m": 0.5}).first()["m"]
    rows = rows.withColumn("margin", F.lit(float(base)))
    residual = F.col("label") - F.col("margin")
    tree_settings = {k: v for k, v in settings.items() if k not in ("maxIter", "stepSize")}
    trees, values, errors, best = [], [], [], 0
    for k in range(settings["maxIter"]):
        gradient = residual if loss == "squared" else F.signum(residual)
        graded = rows.withColumn("gradient", gradient)
        if own_learner is not None:
            tree = own_learner.fit(graded.where("NOT held"), "gradient", tree_settings, seed + k)
        else:
            learner = RandomForestRegressor(labelCol="gradient", predictionCol="guess", leafCol="leaf_vector", numTrees=1,
                                            bootstrap=False, seed=seed + k, maxBins=max_bins, **tree_settings)
            tree = learner.fit(graded.where("NOT held"))
        scored = tree.transform(graded)
        if loss == "squared":
            step, own = F.col("guess"), None
        else:
            # Medians pass over the leaves several times; the trees are gone through once.
            scored = materialise(scored.select(*kept_columns, vector_to_array("leaf_vector")[0].cast("int").alias("leaf"),
                                               residual.alias("residual")))
            own = group_medians(scored.where("NOT held"), "residual", "leaf")
            listed = [float(own.get(leaf, 0.0)) for leaf in range(max(own) + 1)]
            step = F.coalesce(F.get(F.lit(listed), F.col("leaf")), F.lit(0.0))
        rows = scored.withColumn("margin", F.col("margin") + F.lit(float(settings["stepSize"])) * step) \
            .select(*kept_columns)
        if loss == "squared" and (k + 1) % CUT == 0:
            rows = materialise(rows)
        trees.append(tree)
        values.append(own)
        if validation:
            errors.append(rows.where("held").agg(F.avg(F.abs(residual))).first()[0])
            # Without a held-out row there is no error to go by.
            if errors[-1] is not None and (best == 0 or errors[-1] < errors[best - 1]):
                best = k + 1
            if patience is not None and best and k + 1 - best >= patience:
                break
    kept = best or len(trees)
    model = _ensemble(train.sparkSession, trees[:kept], values[:kept], float(base), start["n"],
                      {**settings, "lossType": loss, "maxBins": max_bins, "seed": seed, "maxIter": max(1, kept)})
    return Boosted(model, errors, kept)


def boost_wide(train: DataFrame, learner: wide.Learner, settings: Mapping, seed: int = 42, max_bins: int = 32) -> GBTRegressionModel:
    """Spark's boosting under squared error with trees for many categories.

    As there, the first tree has the labels and the whole weight, the others twice the residuals and the step.
    """
    rows = materialise(learner.prepare(train.select("features", F.col("label").cast("double").alias("label"))))
    kept_columns, count, trees = [*rows.columns, "margin"], rows.count(), []
    tree_settings = {k: v for k, v in settings.items() if k not in ("maxIter", "stepSize")}
    rows = rows.withColumn("margin", F.lit(0.0))
    for k in range(settings["maxIter"]):
        weight, scale = (settings["stepSize"], 2.0) if k else (1.0, 1.0)
        graded = rows.withColumn("gradient", F.lit(scale) * (F.col("label") - F.col("margin")))
        trees.append(learner.fit(graded, "gradient", tree_settings, seed + k))
        rows = trees[-1].transform(graded).withColumn("margin", F.col("margin") + F.lit(float(weight)) * F.col("guess")).select(*kept_columns)
        if (k + 1) % CUT == 0:
            rows = materialise(rows)
    return _ensemble(train.sparkSession, trees, [None] * len(trees), None, count,
                     {**settings, "lossType": "squared", "maxBins": max_bins, "seed": seed})


def boost_in_memory(train: DataFrame, loss: str, settings: Mapping, validation: str | None = None, patience: int | None = None,
                    seed: int = 42, max_bins: int = 32) -> Boosted | None:
    """Boost rows that fit in one task's memory there; None if they do not or their inputs have no categories.

    Squared error is boosted as Spark does, absolute error as ``boost`` does.
    """
    inputs, settings = wide.inputs_of(train), {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, **settings}
    if inputs is None or not inputs.categorical:
        return None
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    rows = train.select("features", F.col("label").cast("double").alias("label"), held.alias("held")).where("label IS NOT NULL")
    if not rounds.fits(inputs, rows.count(), settings):
        return None
    rows = materialise(rows)
    fitted = rows.where("NOT held")
    if fitted.isEmpty():
        raise ValueError("There is no training row with a label.")
    learner = wide.Learner(inputs, wide.cuts_of(fitted, inputs, max_bins))
    return Boosted(*rounds.boost(rows, learner, loss, settings, patience, seed, max_bins))


def best_round(errors: Sequence[float], patience: int | None) -> tuple[int, int]:
    """The round (from 1) of the smallest error before patience runs out, and the last round looked at."""
    best = 1
    for k, error in enumerate(errors, 1):
        if error < errors[best - 1]:
            best = k
        if patience is not None and k - best >= patience:
            return best, k
    return best, len(errors)


def cut_back(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first ``rounds`` trees, by leaving the others out of the written model."""
    spark = SparkSession.active()
    folder = fresh_path(spark, "boosted")
    model.save(f"{folder}/whole")
    spark.read.parquet(f"{folder}/whole/data").where(F.col("treeID") < rounds).write.parquet(f"{folder}/cut/data")
    spark.read.parquet(f"{folder}/whole/treesMetadata").where(F.col("_1") < rounds).write.parquet(f"{folder}/cut/treesMetadata")
    described = json.loads(spark.read.text(f"{folder}/whole/metadata").first()[0]) | {"numTrees": rounds}
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{folder}/cut/metadata")
    return GBTRegressionModel.load(f"{folder}/cut")


def stopped(model: GBTRegressionModel, held: DataFrame, patience: int | None) -> Boosted:
    """A fitted model cut back to its best round on held-out rows, all of whose staged errors are taken in one pass."""
    if held.isEmpty():
        return Boosted(model, [], model.getNumTrees)
    errors = model.evaluateEachIteration(held, "absolute")
    best, last = best_round(errors, patience)
    return Boosted(model if best == len(errors) else cut_back(model, best), errors[:last], best)


def rounds_table(spark: SparkSession, boosted: Boosted) -> DataFrame:
    """``round, val_mae, best``: the held-out error after each round and the round the model was cut back to."""
    rows = [(i + 1, e, i + 1 == boosted.best_round) for i, e in enumerate(boosted.errors)]
    return spark.createDataFrame(rows, "round long, val_mae double, best boolean")
