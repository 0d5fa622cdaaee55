"""Random forests of full size: the top of a tree by histograms of all rows, the rest where a node's rows meet.

Spark's forest sends a histogram of every open node from every part through a shuffle. Far
down, nodes have fewer rows than their histograms have bins: most of the work is shuffling
zeros. Here only nodes of more than ``GROUP_ROWS`` rows are split by histograms added up over
all parts; the rows of a smaller node are brought together once, and its whole subtree is
grown in one group, whose size is bounded. Trees are grown some at a time (``WAVE_ROWS``), which
bounds what lies in shuffles.

A tree is that of Spark's regressor: as many bins of each input, rows drawn with repeats
(Poisson), some inputs drawn for every node, the cut of the largest fall of the variance, mean
leaves. Draws are hashes of seed, tree and job or node, so a forest does not depend on how rows are
dealt or on where its trees are cut into groups.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.operators.checkpoints import fresh_path, materialise, spread

# Rows of a node, counted with repeats, up to which its subtree is grown in one group.
GROUP_ROWS = 1 << 20
# Rows times trees brought together at a time.
WAVE_ROWS = 1 << 28
BLOCK_ROWS = 1 << 15
PARTS = "tree int, ids binary, feature binary, bin binary, n binary, total binary, squares binary"


def _mix(z: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    with np.errstate(over="ignore"):
        z = z + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _salt(seed: int, tree: int, use: int) -> np.uint64:
    return _mix(_mix(np.array([(seed << 2) + use], dtype=np.int64).astype(np.uint64)) + np.uint64(tree))[0]


@dataclass(frozen=True)
class Shape:
    """What a tree needs to know: inputs, bins, inputs drawn per node, depth, rows per leaf, rate of the draw (None: all), seed."""

    inputs: int
    bins: int
    drawn: int
    depth: int
    leaf_rows: float
    rate: float | None
    seed: int

    def weights(self, key: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is drawn for a tree."""
        if self.rate is None:
            return np.ones(len(key))
        terms = [math.exp(-self.rate)]
        for k in range(1, 40):
            terms.append(terms[-1] * self.rate / k)
        u = (_mix(key ^ _salt(self.seed, tree, 0)) >> np.uint64(11)) * 2.0 ** -53
        return np.searchsorted(np.cumsum(terms), u, side="right").astype(float)

    def subset(self, tree: int, ids: np.ndarray) -> np.ndarray:
        """The inputs drawn for each node, in ascending order."""
        if self.drawn == self.inputs:
            return np.tile(np.arange(self.inputs), (len(ids), 1))
        with np.errstate(over="ignore"):
            cells = ids.astype(np.uint64)[:, None] * np.uint64(self.inputs) + np.arange(self.inputs, dtype=np.uint64)
        order = np.argsort(_mix(cells ^ _salt(self.seed, tree, 1)), axis=1, kind="stable")
        return np.sort(order[:, :self.drawn], axis=1)


def _drawn(strategy: str, inputs: int, trees: int) -> int:
    """Inputs per node by Spark's names of strategies."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {"all": inputs, "sqrt": math.ceil(math.sqrt(inputs)), "log2": max(1, math.ceil(math.log2(inputs))),
             "onethird": math.ceil(inputs / 3.0)}
    if strategy in named:
        return named[strategy]
    return min(inputs, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * inputs)


def thresholds(rows: DataFrame, inputs: int, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each input (entries of the array ``x``), at most ``bins - 1``.

    Inputs of at most ``bins`` values are cut midway between neighbours; others at values of
    equal shares of all rows.
    """
    def some_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.empty(0)] * inputs
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                seen = [np.union1d(known, np.unique(x[:, i]))[:bins + 1] if len(known) <= bins else known
                        for i, known in enumerate(seen)]
        yield pd.DataFrame([(i, float(v)) for i, known in enumerate(seen) for v in known], columns=["i", "v"])

    found: dict[int, set] = {i: set() for i in range(inputs)}
    for r in rows.select("x").mapInPandas(some_values, "i int, v double").distinct().collect():
        found[r["i"]].add(r["v"])
    many = [i for i in range(inputs) if len(found[i]) > bins]
    cuts = {i: np.array([(a + b) / 2 for a, b in zip(sorted(found[i]), sorted(found[i])[1:])]) for i in range(inputs)}
    if many:
        shares = [k / bins for k in range(1, bins)]
        marks = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"c{i}") for i in many]).first()
        cuts |= {i: np.unique(marks[f"c{i}"]) for i in many}
    return [cuts[i] for i in range(inputs)]


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _blocks(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Blocks of rows: keys, labels and bins, each in one piece."""
    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        all_rows = pd.concat(held)
        x = _binned(np.stack(all_rows["x"].to_numpy()), cuts)
        return pd.DataFrame([(all_rows["key"].to_numpy(np.int64).tobytes(), all_rows["label"].to_numpy(float).tobytes(), x.tobytes())],
                            columns=["key", "label", "x"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
            if count >= BLOCK_ROWS:
                yield block(held)
                held, count = [], 0
        if held:
            yield block(held)

    return rows.mapInPandas(pack, "key binary, label binary, x binary")


def _unpacked(batches: Iterator[pd.DataFrame], inputs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for key, label, x in batch.itertuples(index=False):
            yield np.frombuffer(key, np.uint64), np.frombuffer(label), np.frombuffer(x, np.uint8).reshape(-1, inputs)


def _histograms(shape: Shape, x: np.ndarray, y: np.ndarray, w: np.ndarray, pos: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """Rows and sums of labels by drawn input, node and bin."""
    wy, start, cells = w * y, pos * shape.bins, len(subset) * shape.bins
    flat, base = x.ravel(), np.arange(len(x)) * shape.inputs
    out, drawn = np.empty((2, shape.drawn, cells)), np.ascontiguousarray(subset.T)
    for s in range(shape.drawn):
        cell = start + flat[base + drawn[s][pos]]
        out[0, s], out[1, s] = np.bincount(cell, w, cells), np.bincount(cell, wy, cells)
    return out.reshape(2, shape.drawn, len(subset), shape.bins)


def _best(shape: Shape, hist: np.ndarray, squares: np.ndarray, subset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input (-1: none) and bin of each node's best cut, and the rows left of it."""
    n, s = hist[0, 0].sum(-1), hist[1, 0].sum(-1)
    left, left_sum = np.cumsum(hist[0], -1)[..., :-1], np.cumsum(hist[1], -1)[..., :-1]
    right, right_sum = n[:, None] - left, s[:, None] - left_sum
    fits = (left >= shape.leaf_rows) & (right >= shape.leaf_rows) & (left > 0) & (right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_sum ** 2 / left + right_sum ** 2 / right - (s ** 2 / n)[:, None], -np.inf)
    gain = gain.transpose(1, 0, 2).reshape(len(n), -1)
    at = gain.argmax(1)
    nodes, slot, cut = np.arange(len(n)), at // (shape.bins - 1), at % (shape.bins - 1)
    # What rounding leaves of equal labels is no gain.
    chosen = np.where(gain[nodes, at] > 1e-12 * squares, subset[nodes, slot], -1)
    return chosen, cut, left[slot, nodes, cut]


def _subtree(shape: Shape, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Nodes below and with ``root`` (numbered as in a heap, from 1): id, input, bin, rows, sum and squares of labels."""
    ids, pos, level, found = np.array([root], dtype=np.int64), np.zeros(len(x), dtype=np.int64), int(root).bit_length() - 1, []
    while len(ids):
        wy = w * y
        n, s, q = (np.bincount(pos, v, len(ids)) for v in (w, wy, wy * y))
        if level == shape.depth:
            none = np.full(len(ids), -1)
            found.append((ids, none, none, n, s, q))
            break
        subset = shape.subset(tree, ids)
        chosen, cut, _ = _best(shape, _histograms(shape, x, y, w, pos, subset), q, subset)
        found.append((ids, chosen, cut, n, s, q))
        split = chosen >= 0
        if not split.all():
            kept = split[pos]
            x, y, w, pos = x[kept], y[kept], w[kept], pos[kept]
        right = x.ravel()[np.arange(len(x)) * shape.inputs + chosen[pos]] > cut[pos]
        pos = (2 * (np.cumsum(split) - 1))[pos] + right
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()
        level += 1
    return [np.concatenate(part) for part in zip(*found)]


def _row(tree: int, nodes: Sequence[np.ndarray]) -> tuple:
    types = (np.int64, np.int16, np.int16, np.float64, np.float64, np.float64)
    return (tree, *[np.asarray(part).astype(t).tobytes() for part, t in zip(nodes, types)])


class _Top:
    """The part of a tree that the driver knows: few nodes of many rows each."""

    def __init__(self):
        self.cuts: dict[int, tuple[int, int]] = {}
        self.stats: dict[int, tuple[float, float, float]] = {}
        self.open, self.small = [], []

    def place(self, x: np.ndarray, levels: int, nodes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have reached one of ascending ``nodes`` after some levels, and its place among them."""
        ids = np.array(sorted({1, *(c for node in self.cuts for c in (node, 2 * node, 2 * node + 1))}), dtype=np.int64)
        # A node that is not split leads to itself: no bin lies above 255.
        f, b, to = np.zeros(len(ids), dtype=np.intp), np.full(len(ids), 255, dtype=np.uint8), np.arange(len(ids), dtype=np.intp)
        for node, (feature, cut) in self.cuts.items():
            i = np.searchsorted(ids, node)
            f[i], b[i], to[i] = feature, cut, np.searchsorted(ids, 2 * node)
        # Rows that have left all ways to the nodes are not followed.
        wanted = np.isin(ids, [node >> k for node in nodes for k in range(int(node).bit_length())])
        flat, rows, at = x.ravel(), np.arange(len(x)), np.zeros(len(x), dtype=np.intp)
        base = rows * x.shape[1]
        for _ in range(levels):
            at = to[at] + (flat[base + f[at]] > b[at])
            kept = np.flatnonzero(wanted[at])
            if 4 * len(kept) < 3 * len(at):
                at, rows, base = at[kept], rows[kept], base[kept]
        pos = _numbered(nodes, ids)[at]
        kept = pos >= 0
        return (rows, pos) if kept.all() else (rows[kept], pos[kept])

    def drawn(self, shape: Shape, tree: int, key: np.ndarray, x: np.ndarray, levels: int,
              nodes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows drawn for a tree that are in one of ``nodes``, the place of its node, and how often each is drawn."""
        rows, pos = self.place(x, levels, nodes)
        w = shape.weights(key[rows], tree)
        kept = np.flatnonzero(w)
        return rows[kept], pos[kept], w[kept]


def _numbered(nodes: Sequence[int], at: np.ndarray) -> np.ndarray:
    """The place of each row's node among ascending ``nodes``, -1 if it is none of them."""
    known = np.asarray(nodes, dtype=np.int64)
    place = np.minimum(np.searchsorted(known, at), len(known) - 1)
    return np.where(known[place] == at, place, -1)


def _split_top(blocks: DataFrame, shape: Shape, tops: dict[int, _Top], level: int, group_rows: int) -> None:
    """Split the open nodes of one level by histograms of all rows."""
    wanted = {tree: top for tree, top in tops.items() if top.open}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for key, y, x in _unpacked(batches, shape.inputs):
            for tree, top in wanted.items():
                rows, pos, w = top.drawn(shape, tree, key, x, level, top.open)
                here, own_y = x[rows], y[rows]
                subset = shape.subset(tree, np.array(top.open))
                own = _histograms(shape, here, own_y, w, pos, subset).ravel()
                squares = np.bincount(pos, w * own_y ** 2, len(top.open))
                sums[tree] = np.concatenate([own, squares]) + sums.get(tree, 0.0)
        yield pd.DataFrame([(tree, own.tobytes()) for tree, own in sums.items()], columns=["tree", "sums"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes = np.array(wanted[tree].open)
        added = sum(np.frombuffer(b) for b in pdf["sums"])
        hist, squares = added[:-len(nodes)].reshape(2, shape.drawn, len(nodes), shape.bins), added[-len(nodes):]
        subset = shape.subset(tree, nodes)
        chosen, cut, left = _best(shape, hist, squares, subset)
        return pd.DataFrame({"tree": tree, "node": nodes, "f": chosen, "b": cut, "n_left": left, "n": hist[0, 0].sum(-1),
                             "total": hist[1, 0].sum(-1), "squares": squares})

    split = blocks.mapInPandas(count, "tree int, sums binary").groupBy("tree") \
        .applyInPandas(choose, "tree int, node long, f int, b int, n_left double, n double, total double, squares double").collect()
    for top in wanted.values():
        top.open = []
    for r in sorted(split, key=lambda r: (r["tree"], r["node"])):
        top, node = tops[r["tree"]], r["node"]
        top.stats[node] = (r["n"], r["total"], r["squares"])
        if r["f"] < 0:
            continue
        top.cuts[node] = (r["f"], r["b"])
        for child, n in ((2 * node, r["n_left"]), (2 * node + 1, r["n"] - r["n_left"])):
            # A node at the last level is a leaf, which a group of its sums gives as well.
            (top.open if n > group_rows and level + 1 < shape.depth else top.small).append(child)


def _grow_small(blocks: DataFrame, shape: Shape, tops: dict[int, _Top], level: int) -> DataFrame:
    """Bring the rows of each small node together and grow its subtree there; leaves of the last level as sums."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, y, x in _unpacked(batches, shape.inputs):
            out = []
            for tree, top in tops.items():
                rows, pos, w = top.drawn(shape, tree, key, x, level, top.small)
                order = np.argsort(pos.astype(np.uint16) if len(top.small) <= 1 << 16 else pos, kind="stable")
                ends = np.searchsorted(pos[order], np.arange(len(top.small) + 1))
                for i, node in enumerate(top.small):
                    here = order[ends[i]:ends[i + 1]]
                    if not len(here):
                        continue
                    at, own_w = rows[here], w[here]
                    if node.bit_length() - 1 == shape.depth:
                        wy = own_w * y[at]
                        out.append((tree, node, b"", np.array([wy.sum(), (wy * y[at]).sum()]).tobytes(),
                                    np.array([own_w.sum()]).tobytes()))
                    else:
                        out.append((tree, node, x[at].tobytes(), y[at].tobytes(), own_w.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["tree", "node", "x", "y", "w"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        if node.bit_length() - 1 == shape.depth:
            s, q = sum(np.frombuffer(b) for b in pdf["y"])
            nodes = [np.array([v]) for v in (node, -1, -1, sum(np.frombuffer(b)[0] for b in pdf["w"]), s, q)]
        else:
            nodes = _subtree(shape, tree, node, np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(-1, shape.inputs),
                             np.frombuffer(b"".join(pdf["y"])), np.frombuffer(b"".join(pdf["w"]), np.uint8).astype(float))
        return pd.DataFrame([_row(tree, nodes)], columns=[c.split()[0] for c in PARTS.split(", ")])

    return blocks.mapInPandas(deal, "tree int, node long, x binary, y binary, w binary") \
        .groupBy("tree", "node").applyInPandas(grow, PARTS)


def _tree(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """A tree's nodes in the order of their ids, with the place of the left child (the right one is next; -1: leaf)."""
    types = (np.int64, np.int16, np.int16, np.float64, np.float64, np.float64)
    parts = [np.concatenate([np.frombuffer(b, t) for b in pdf[c.split()[0]]]) for c, t in zip(PARTS.split(", ")[1:], types)]
    order = np.argsort(parts[0])
    ids, feature, cut, n, total, squares = (p[order] for p in parts)
    left = np.where(feature >= 0, np.searchsorted(ids, 2 * ids), -1)
    return feature, cut, left, n, total, squares


@dataclass(frozen=True)
class Forest:
    """Grown trees: cuts of the inputs, and the pieces of all trees in a written table.

    Scoring sends the trees, 13 bytes a node, to all workers; ``spark_model`` gives the same
    forest as Spark's own model.
    """

    cuts: list[np.ndarray]
    depth: int
    trees: int
    parts: DataFrame
    settings: Mapping

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, the mean of the trees."""
        def compact(pdf: pd.DataFrame) -> pd.DataFrame:
            feature, cut, left, n, total, _ = _tree(pdf)
            here = np.arange(len(left))
            leaf = left < 0
            # A leaf leads to itself: no bin lies above 255.
            packed = (np.where(leaf, 0, feature).astype(np.uint16), np.where(leaf, 255, cut).astype(np.uint8),
                      np.where(leaf, here, left).astype(np.int32), total / n)
            return pd.DataFrame([(int(pdf["tree"].iloc[0]), *[p.tobytes() for p in packed])], columns=["tree", "f", "b", "l", "v"])

        trees = self.parts.groupBy("tree").applyInPandas(compact, "tree int, f binary, b binary, l binary, v binary").collect()
        sent = df.sparkSession.sparkContext.broadcast([tuple(r)[1:] for r in sorted(trees, key=lambda r: r["tree"])])
        cuts, depth = self.cuts, self.depth

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            flat = _binned(np.stack(features.to_numpy()), cuts)
            base, flat = np.arange(len(flat)) * flat.shape[1], flat.ravel()
            out = np.zeros(len(base))
            for f, b, l, v in sent.value:
                f, b, l, v = np.frombuffer(f, np.uint16), np.frombuffer(b, np.uint8), np.frombuffer(l, np.int32), np.frombuffer(v)
                at = np.zeros(len(base), dtype=np.int32)
                for _ in range(depth):
                    at = l[at] + (flat[base + f[at]] > b[at])
                out += v[at]
            return pd.Series(out / len(sent.value))

        return df.withColumn("prediction", predict(vector_to_array("features")))

    def spark_model(self) -> RandomForestRegressionModel:
        """The same trees written in Spark's model format and loaded."""
        spark, cuts = self.parts.sparkSession, self.cuts
        folder = fresh_path(spark, "forest")

        def nodes(pdf: pd.DataFrame) -> pd.DataFrame:
            feature, cut, left, n, total, squares = _tree(pdf)
            inner, mean = left >= 0, total / n
            impurity = np.maximum(squares / n - mean ** 2, 0.0)
            lo, hi = left[inner], left[inner] + 1
            gain = np.full(len(left), -1.0)
            gain[inner] = impurity[inner] - (n[lo] * impurity[lo] + n[hi] * impurity[hi]) / n[inner]
            return pd.DataFrame({"treeID": int(pdf["tree"].iloc[0]), "id": np.arange(len(left)), "prediction": mean,
                                 "impurity": impurity, "n": n, "total": total, "squares": squares, "gain": gain,
                                 "leftChild": left, "rightChild": np.where(inner, left + 1, -1), "feature": feature,
                                 "cut": [float(cuts[f][b]) if f >= 0 else None for f, b in zip(feature, cut)]})

        flat = self.parts.groupBy("tree").applyInPandas(
            nodes, "treeID int, id int, prediction double, impurity double, n double, total double, squares double, gain double, "
                   "leftChild int, rightChild int, feature int, cut double")
        split = F.struct(F.col("feature").alias("featureIndex"),
                         F.array_compact(F.array("cut")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        flat.select("treeID", F.struct("id", "prediction", "impurity", F.array("n", "total", "squares").alias("impurityStats"),
                                       F.col("n").cast("long").alias("rawCount"), "gain", "leftChild", "rightChild",
                                       split.alias("split")).alias("nodeData")).write.parquet(f"{folder}/model/data")
        DecisionTreeRegressor(maxDepth=self.depth).save(f"{folder}/tree")
        own = json.loads(spark.read.text(f"{folder}/tree/metadata").first()[0])
        own |= {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "numFeatures": len(cuts)}
        named = [(i, json.dumps(own | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0) for i in range(self.trees)]
        spark.createDataFrame(named, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/model/treesMetadata")
        RandomForestRegressor(**self.settings).save(f"{folder}/estimator")
        described = json.loads(spark.read.text(f"{folder}/estimator/metadata").first()[0])
        described |= {"class": "org.apache.spark.ml.regression.RandomForestRegressionModel", "numFeatures": len(cuts),
                      "numTrees": self.trees}
        spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{folder}/model/metadata")
        return RandomForestRegressionModel.load(f"{folder}/model")


def grow(train: DataFrame, params: Mapping | None = None, seed: int = 42, max_bins: int = 32, key: str = "job_id",
         group_rows: int = GROUP_ROWS, wave_rows: int = WAVE_ROWS) -> Forest:
    """Grow a forest on ``features, label``; ``params`` are those of Spark's random forest.

    ``key`` is a whole number that tells rows apart. Rows without a label are left out.
    """
    settings = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "auto", "subsamplingRate": 1.0,
                "bootstrap": True, **(params or {})}
    if max_bins > 256:
        raise ValueError("Inputs have at most 256 bins.")
    rows = train.where("label IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.col("label").cast("double").alias("label"),
                                                   vector_to_array("features").alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("There is no training row with a label.")
    inputs, trees = len(first["x"]), settings["numTrees"]
    cuts = thresholds(rows, inputs, max_bins)
    blocks = materialise(_blocks(spread(rows, "key"), cuts))
    shape = Shape(inputs, max_bins, _drawn(settings["featureSubsetStrategy"], inputs, trees), settings["maxDepth"],
                  settings["minInstancesPerNode"], settings["subsamplingRate"] if settings["bootstrap"] else None, seed)
    count = blocks.agg(F.sum(F.length("key")).alias("n")).first()["n"] // 8
    spark, parts = train.sparkSession, None
    wave = max(1, wave_rows // count)
    for begin in range(0, trees, wave):
        grown = _grow_wave(spark, blocks, shape, range(begin, min(trees, begin + wave)), count, group_rows)
        parts = grown if parts is None else parts.unionByName(grown)
    described = {**settings, "seed": seed, "maxBins": max_bins}
    return Forest(cuts, shape.depth, trees, parts, described)


def _grow_wave(spark: SparkSession, blocks: DataFrame, shape: Shape, trees: Sequence[int], count: int, group_rows: int) -> DataFrame:
    tops, level = {tree: _Top() for tree in trees}, 0
    for top in tops.values():
        (top.open if count > group_rows and shape.depth else top.small).append(1)
    while any(top.open for top in tops.values()):
        _split_top(blocks, shape, tops, level, group_rows)
        level += 1
    for top in tops.values():
        top.small.sort()
    known = [_row(tree, list(zip(*[(node, *top.cuts.get(node, (-1, -1)), *stats) for node, stats in top.stats.items()])))
             for tree, top in tops.items() if top.stats]
    grown = materialise(_grow_small(blocks, shape, {t: top for t, top in tops.items() if top.small}, level))
    return grown.unionByName(spark.createDataFrame(known, PARTS)) if known else grown
