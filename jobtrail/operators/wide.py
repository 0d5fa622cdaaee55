"""Regression trees over inputs of many categories, as Spark models.

Spark's trees write a one-hot vector out as one number per category and row, and give every
input as many bins as the largest one has categories. Here a row keeps its bins, its category
numbers and the places of its one-hot entries that are set. A histogram of a node has the bins
each input really has; of one-hot entries only the set ones are counted, and the others are the
rest of the node. Parts add up their own histograms, one group per input and node adds up
those of all parts and finds the input's best cut; only these come to the driver.

Cuts are those of Spark's regression trees: numbers at bin ends, one-hot entries alone, categories
in the order of their means in the node.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from jobtrail.operators import forest
from jobtrail.operators.checkpoints import fresh_path, materialise
from jobtrail.operators.scan import BLOCK, Scan, _scan_blocks

# Inputs from which on one-hot vectors, and categories from which on numbered ones, count as wide.
WIDE_ENTRIES, WIDE_CATEGORIES = 100, 100
# Rows counted at a time.
BLOCK_ROWS = 1 << 18
# One-hot entries whose sums lie in one group.
ENTRIES = 1 << 16


@dataclass(frozen=True)
class Inputs:
    """Entries of a vector by their kind: places of numbers, of category numbers with their counts, of one-hot entries."""

    entries: int
    numbers: list[int]
    nominal: dict[int, int]
    onehot: np.ndarray

    @property
    def categorical(self) -> bool:
        return bool(len(self.onehot) or self.nominal)

    @property
    def wide(self) -> bool:
        return len(self.onehot) > WIDE_ENTRIES or max(self.nominal.values(), default=0) > WIDE_CATEGORIES


def inputs_of(df: DataFrame, column: str = "features") -> Inputs | None:
    """The kinds of a vector's entries by its metadata; None if it has none."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs")
    if not attrs:
        return None
    nominal = {a["idx"]: a.get("num_vals") or len(a.get("vals", [])) for a in attrs.get("nominal", [])}
    onehot = np.array(sorted(a["idx"] for a in attrs.get("binary", [])), dtype=np.int64)
    numbers = sorted(a["idx"] for a in attrs.get("numeric", []))
    return Inputs(len(numbers) + len(nominal) + len(onehot), numbers, nominal, onehot)


def _sparse(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of the entries of vectors written as text."""
    places, values, counts = [], [], []
    for text in texts:
        if text[0] == "(":
            _, at, value = re.split(r",\[", text[1:-2])
            at = at[:-1]
        else:
            value = text[1:-1]
            at = ",".join(map(str, range(value.count(",") + 1)))
        counts.append(at.count(",") + 1 if at else 0)
        if at:
            places.append(at)
            values.append(value)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        return rows, rows, rows.astype(float)
    return rows, np.array(",".join(places).split(","), dtype=np.int64), np.array(",".join(values).split(","), dtype=float)


def _entries(rows: DataFrame, inputs: Inputs) -> DataFrame:
    """``dense`` (numbers, then category numbers) and ``marks`` (which one-hot entries are set, counted among them)."""
    kept = [c for c in rows.columns if c != "features"]
    dense = [*inputs.numbers, *inputs.nominal]
    if not len(inputs.onehot):
        array = vector_to_array("features")
        return rows.select(*kept, F.array(*[array[i] for i in dense]).alias("dense"), F.array().cast("array<int>").alias("marks"))
    place = {i: k for k, i in enumerate(dense)}
    onehot = inputs.onehot

    @F.pandas_udf("dense array<double>, marks array<int>")
    def split(texts: pd.Series) -> pd.DataFrame:
        row, at, value = _sparse(texts)
        mark = np.searchsorted(onehot, at)
        is_mark = (mark < len(onehot)) & (onehot[np.minimum(mark, len(onehot) - 1)] == at)
        table = np.zeros((len(texts), len(dense)))
        table[row[~is_mark], [place[i] for i in at[~is_mark]]] = value[~is_mark]
        is_set = is_mark & (value > 0.5)
        ends = np.cumsum(np.bincount(row[is_set], minlength=len(texts)))[:-1]
        return pd.DataFrame({"dense": list(table), "marks": np.split(mark[is_set].astype(np.int32), ends)})

    return rows.withColumn("_e", split(F.col("features").cast("string"))).select(*kept, "_e.dense", "_e.marks")


def cuts_of(rows: DataFrame, inputs: Inputs, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each number, at most ``bins - 1``: midway between values, or at values of equal shares of all rows."""
    count = len(inputs.numbers)
    numbers = materialise(_entries(rows.select("features"), inputs).select(F.slice("dense", 1, count).alias("x"))) if count else None
    if not count or bins <= 256:
        return forest.thresholds(numbers, count, bins) if count else []
    total, out = numbers.count(), []
    for i in range(count):
        values = numbers.select(F.col("x")[i].alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        known = [r["v"] for r in values.select("v").limit(bins + 1).collect()]
        if len(known) <= bins:
            known.sort()
            out.append(np.array([(a + b) / 2 for a, b in zip(known, known[1:])]))
            continue
        ranged = materialise(values.repartitionByRange("v").withColumn(BLOCK, F.spark_partition_id().cast("bigint")))
        ranked = _scan_blocks(ranged, [], ["v"], [Scan("upto", "sum", "n")], (), ["v", "n"])
        ends = ranked.groupBy(F.floor((F.col("upto") - 1) * bins / total).alias("b")).agg(F.max("v").alias("v"))
        out.append(np.unique([r["v"] for r in ends.where(F.col("b") < bins - 1).select("v").collect()]))
    return out


@dataclass(frozen=True)
class Learner:
    """Fits trees to a column of rows to which ``prepare`` has added ``binned``."""

    inputs: Inputs
    cuts: list[np.ndarray]

    @property
    def sizes(self) -> list[int]:
        """Bins of each number and categories of each category number."""
        return [len(c) + 1 for c in self.cuts] + list(self.inputs.nominal.values())

    def prepare(self, rows: DataFrame) -> DataFrame:
        cuts = self.cuts

        @F.pandas_udf("binary")
        def encode(dense: pd.Series, marks: pd.Series) -> pd.Series:
            table = np.stack(dense.to_numpy()) if len(dense) else np.empty((0, 1))
            bins = np.stack([np.searchsorted(cuts[i], table[:, i]) if i < len(cuts) else table[:, i].astype(np.int64)
                             for i in range(table.shape[1])], axis=1).astype(np.int32)
            return pd.Series([b.tobytes() + np.asarray(m, dtype=np.int32).tobytes() for b, m in zip(bins, marks)])

        kept = rows.columns
        with_entries = _entries(rows.withColumn("_f", F.col("features")), self.inputs)
        out = with_entries.withColumn("binned", encode("dense", "marks"))
        return out.select(*[F.col("_f").alias("features") if c == "features" else F.col(c) for c in kept], "binned")

    def fit(self, rows: DataFrame, label: str, settings: Mapping, seed: int) -> RandomForestRegressionModel:
        """One tree, as a forest of one; ``settings`` are those of Spark's trees."""
        limits = {"maxDepth": 5, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", **settings}
        blocks = materialise(_blocks(rows.select("binned", F.col(label).cast("double").alias("y"))))
        cuts, stats, open_nodes = {}, {}, [1]
        for level in range(limits["maxDepth"] + 1):
            found = self._level(blocks, cuts, open_nodes, limits, seed, level)
            if level == 0 and not found:
                raise ValueError("There is no training row with a label.")
            following = []
            for node in open_nodes:
                of_node = [r for r in found if r["node"] == node]
                stats[node] = (of_node[0]["n"], of_node[0]["total"], of_node[0]["squares"])
                n, _, squares = stats[node]
                best = max((r for r in of_node if r["input"] >= 0), key=lambda r: (r["gain"], -r["input"]), default=None)
                if level < limits["maxDepth"] and best is not None and best["gain"] > 1e-12 * squares:
                    left = np.frombuffer(best["members"], np.int32) if best["members"] is not None else None
                    cuts[node] = (best["input"], best["at"], left)
                    following += [2 * node, 2 * node + 1]
            open_nodes = following
            if not open_nodes:
                break
        return _model(rows, self, cuts, stats, limits)

    def _level(self, blocks: DataFrame, cuts: Mapping, nodes: Sequence[int], limits: Mapping, seed: int, level: int) -> list:
        inputs, sizes, rate, leaf_rows = self.inputs, self.sizes, limits["subsamplingRate"], limits["minInstancesPerNode"]
        numbers, width, onehot = len(self.cuts), len(self.sizes), len(self.inputs.onehot)
        order = [*inputs.numbers, *inputs.nominal]
        place = {i: k for k, i in enumerate(order)}
        drawn, last = forest._drawn(limits["featureSubsetStrategy"], inputs.entries, 1), level == limits["maxDepth"]
        known = np.array(nodes, dtype=np.int64)

        def allowed(node: int) -> np.ndarray:
            out = np.zeros(inputs.entries, dtype=bool)
            out[np.random.default_rng([seed, node]).permutation(inputs.entries)[:drawn]] = True
            return out

        def goes_right(at: np.ndarray, bins: np.ndarray, owner: np.ndarray, mark: np.ndarray, others: Mapping) -> np.ndarray:
            right = np.zeros(len(at), dtype=bool)
            for node in np.unique(at):
                if node not in cuts:
                    continue
                i, where, left = cuts[node]
                here = at == node
                if i in place:
                    own = bins[:, place[i]]
                    right |= here & (own > where if left is None else others[node][own])
                else:
                    is_set = np.zeros(len(at), dtype=bool)
                    is_set[owner[mark == np.searchsorted(inputs.onehot, i)]] = True
                    right |= here & is_set
            return right

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            totals, others = np.zeros((3, len(known))), {}
            for node, (i, _, left) in cuts.items():
                if left is not None:
                    others[node] = np.ones(inputs.nominal[i], dtype=bool)
                    others[node][left] = False
            for batch in batches:
                for block, lengths, y in batch.itertuples(index=False):
                    y, lengths = np.frombuffer(y), np.frombuffer(lengths, np.int32)
                    flat, begin = np.frombuffer(block, np.int32), np.cumsum(lengths) - lengths
                    bins = flat[begin[:, None] + np.arange(width)]
                    owner = np.repeat(np.arange(len(y)), lengths - width)
                    is_mark = np.ones(len(flat), dtype=bool)
                    is_mark[(begin[:, None] + np.arange(width)).ravel()] = False
                    mark = flat[is_mark]
                    at = np.ones(len(y), dtype=np.int64)
                    for depth in range(level):
                        inner = np.isin(at, list(cuts)) & (at >> depth == 1)
                        at = np.where(inner, 2 * at + goes_right(at, bins, owner, mark, others), at)
                    pos = forest._numbered(known, at)
                    if rate < 1:
                        pos[np.random.default_rng([seed, zlib.crc32(block), zlib.crc32(y)]).random(len(y)) >= rate] = -1
                    kept = pos >= 0
                    p, v = pos[kept], y[kept]
                    totals += [np.bincount(p, w, len(known)) for w in (None, v, v * v)]
                    if last:
                        continue
                    for i, size in enumerate(sizes):
                        cell, cells = p * size + bins[kept, i], size * len(known)
                        own = np.stack([np.bincount(cell, w, cells).reshape(len(known), size) for w in (None, v)], axis=1)
                        sums[i] = np.add(sums[i], own, out=sums[i]) if i in sums else own.astype(float)
                    if onehot:
                        counts = kept[owner]
                        cell, w = pos[owner[counts]] * onehot + mark[counts], y[owner[counts]]
                        own = np.stack([np.bincount(cell, u, onehot * len(known)).reshape(len(known), onehot) for u in (None, w)], axis=1)
                        sums[width] = np.add(sums[width], own, out=sums[width]) if width in sums else own.astype(float)
            for k in range(len(known)):
                yield pd.DataFrame([(-1, int(known[k]), totals[:, k].tobytes())], columns=["i", "node", "sums"])
                for i, own in sums.items():
                    pieces = range(0, own.shape[2], ENTRIES) if i == width else [0]
                    for begin in pieces:
                        piece = own[k][:, begin:begin + ENTRIES] if i == width else own[k]
                        yield pd.DataFrame([(i + begin // ENTRIES, int(known[k]), np.concatenate([totals[:, k], piece.ravel()]).tobytes())],
                                           columns=["i", "node", "sums"])

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            i, node = int(pdf["i"].iloc[0]), int(pdf["node"].iloc[0])
            added = sum(np.frombuffer(b) for b in pdf["sums"])
            n, s, q = added[:3]
            out = [node, -1, -1, 0.0, n, s, q, None]
            if i >= 0:
                rows_in, sum_in = added[3:].reshape(2, -1)
                mine = allowed(node)
                if i >= width:
                    begin = (i - width) * ENTRIES
                    right, right_sum, ids = rows_in, sum_in, inputs.onehot[begin:begin + len(rows_in)]
                    left, left_sum, fits = n - right, s - right_sum, mine[ids]
                else:
                    ranks = np.arange(len(rows_in))
                    if i >= numbers:
                        seen = np.flatnonzero(rows_in)
                        ranks = seen[np.argsort(sum_in[seen] / rows_in[seen], kind="stable")]
                    left, left_sum = np.cumsum(rows_in[ranks])[:-1], np.cumsum(sum_in[ranks])[:-1]
                    right, right_sum, fits = n - left, s - left_sum, mine[order[i]]
                fits = fits & (left >= leaf_rows) & (right >= leaf_rows) & (left > 0) & (right > 0)
                if np.any(fits):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(fits, left_sum ** 2 / left + right_sum ** 2 / right - s ** 2 / n, -np.inf)
                    at = int(gain.argmax())
                    out[1] = int(ids[at]) if i >= width else order[i]
                    out[2], out[3] = at, float(gain[at])
                    if numbers <= i < width:
                        out[7] = np.sort(ranks[:at + 1]).astype(np.int32).tobytes()
            return pd.DataFrame([out], columns=["node", "input", "at", "gain", "n", "total", "squares", "members"])

        return [r for r in blocks.mapInPandas(count, "i int, node long, sums binary").groupBy("i", "node").applyInPandas(
            choose, "node long, input int, at int, gain double, n double, total double, squares double, members binary").collect()
            if r["n"] > 0]


def _blocks(rows: DataFrame) -> DataFrame:
    """Some rows at a time in one piece: their bins and marks, how many each has, and the labels."""
    def block(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([tuple(b"".join(part) for part in zip(*held))], columns=["block", "lengths", "y"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            if len(batch):
                lengths = batch["binned"].str.len().to_numpy(np.int32) // 4
                held.append((b"".join(batch["binned"]), lengths.astype(np.int32).tobytes(), batch["y"].to_numpy(float).tobytes()))
                count += len(batch)
            if count >= BLOCK_ROWS:
                yield block(held)
                held, count = [], 0
        if held:
            yield block(held)

    return rows.mapInPandas(pack, "block binary, lengths binary, y binary")


def _model(rows: DataFrame, learner: Learner, cuts: Mapping, stats: Mapping, limits: Mapping) -> RandomForestRegressionModel:
    """The tree in Spark's model format, loaded, with the columns that boosting reads."""
    spark, inputs = rows.sparkSession, learner.inputs
    folder, ids = fresh_path(spark, "wide"), sorted(stats)
    number = {node: k for k, node in enumerate(ids)}
    impurity = {node: max(0.0, q / n - (s / n) ** 2) for node, (n, s, q) in stats.items()}
    nodes = []
    for node in ids:
        n, s, q = stats[node]
        left, right, gain, split = -1, -1, -1.0, (-1, [], -1)
        if node in cuts:
            i, at, members = cuts[node]
            left, right = number[2 * node], number[2 * node + 1]
            gain = impurity[node] - sum(stats[c][0] * impurity[c] for c in (2 * node, 2 * node + 1)) / n
            if members is not None:
                split = (i, [float(c) for c in members], inputs.nominal[i])
            else:
                split = (i, [float(learner.cuts[inputs.numbers.index(i)][at]) if i in inputs.numbers else 0.5], -1)
        nodes.append((0, (number[node], s / n, impurity[node], [n, s, q], int(n), gain, left, right, split)))
    schema = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, " \
             "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, " \
             "numCategories int>>"
    spark.createDataFrame(nodes, schema).coalesce(1).write.parquet(f"{folder}/model/data")
    DecisionTreeRegressor(maxDepth=limits["maxDepth"]).save(f"{folder}/tree")
    own = json.loads(spark.read.text(f"{folder}/tree/metadata").first()[0])
    own |= {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "numFeatures": inputs.entries,
            "uid": f"dtr_{uuid.uuid4().hex[:12]}"}
    spark.createDataFrame([(0, json.dumps(own), 1.0)], "_1 int, _2 string, _3 double").coalesce(1) \
        .write.parquet(f"{folder}/model/treesMetadata")
    RandomForestRegressor(predictionCol="guess", leafCol="leaf_vector", numTrees=1, maxDepth=limits["maxDepth"]).save(f"{folder}/estimator")
    described = json.loads(spark.read.text(f"{folder}/estimator/metadata").first()[0])
    described |= {"class": "org.apache.spark.ml.regression.RandomForestRegressionModel", "numFeatures": inputs.entries, "numTrees": 1}
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{folder}/model/metadata")
    return RandomForestRegressionModel.load(f"{folder}/model")


def learner(rows: DataFrame, bins: int) -> Learner | None:
    """A learner for ``features`` with many categories, None for others."""
    inputs = inputs_of(rows)
    if inputs is None or not inputs.wide:
        return None
    return Learner(inputs, cuts_of(rows, inputs, bins))
