"""Ranked lexical search: exact inner-product search in sparse ball trees.

A document is a sparse vector over the terms of the query items, an item the
vector of its terms' weights, and the score their inner product in 64-bit
integers. Statistics (number of documents, terms and document frequencies) are
sums over all documents. Then each task reads its documents as a stream,
``TREE_DOCS`` at a time: it splits them into a ball tree (two far documents draw
the others to them), and searches it for every item, best
subtree first. A ball's bound is the item's product with its centroid plus the
item's length, over the terms some document of the ball has, times the radius;
all of it is rounded up by more than the error of the floating sums, so a subtree is left out only if none of its documents
can enter the item's best ones. Leaves are scored exactly. What an item has
found so far lifts its threshold for the trees after, and each task returns
``k`` rows an item at most, which a window ranks.

Items are taken in blocks of about ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items
(an item is never cut), each a pass over the documents, so what travels to the
tasks is bounded. Tasks' results are merged in groups of ``MERGED_TASKS`` first.

Defined results: a null or empty text has no terms; documents without terms do
not count, items without terms get no rows; rows that share an item id are one
item with all of their terms; rows that share a document id are documents of
their own, ranked one after the other; null ids rank after all others at equal
scores; an empty table of either kind gives no rows. Only the named columns are
read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtrail.llm.shared import ascii_lower, text_of, written

K = 50
TREE_DOCS, LEAF_DOCS = 8_192, 16
BLOCK_TERMS, BLOCK_ITEMS = 20_000, 512
# Items whose bounds are computed together.
BOUND_ITEMS = 64
MERGED_TASKS = 256
#: Fixed values of the score.
WEIGHT_UNIT, VALUE_UNIT, SATURATION, LENGTH_STEP, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 20, 50
#: A term is a run of anything but these ASCII characters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AS_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item long, doc_id long, score long, seen long, scored long"


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), GAP), lambda t: t != "")


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``item_id, term``: each item's distinct terms."""
    return items.select(F.col(id_column).cast("bigint").alias("item_id"),
                        F.explode(F.array_distinct(terms_of(text_of(text_column)))).alias("term")).distinct()


def item_blocks(pairs: DataFrame, block_terms: int) -> DataFrame:
    """Add ``block``: items are dealt by hash so that a block has about ``block_terms`` pairs and ``BLOCK_ITEMS`` items."""
    items = pairs.select("item_id").distinct().count()
    blocks = max(1, min(items, -(-pairs.count() // block_terms)), -(-items // BLOCK_ITEMS))
    return pairs.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), F.lit(blocks)))


def document_vectors(docs: DataFrame, vocabulary: list[str], id_column: str, text_column: str) -> DataFrame:
    """Each document with terms: their number, and the counts of those in ``vocabulary`` by index."""
    index = {t.encode(): i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = text.as_py().translate(_AS_BYTES).split()
                if not words:
                    continue
                found = Counter(map(index.get, words))
                found.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()),
                "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))})

    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
    return texts.mapInArrow(count, VECTORS)


def weights(vectors: DataFrame, documents: int) -> DataFrame:
    """``term, weight`` of the indexed terms that some document has."""
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")
    return df.select("term", F.floor(F.lit(float(WEIGHT_UNIT)) * F.ln(ratio)).cast("bigint").alias("weight"))


def with_values(vectors: DataFrame, documents: int, length: int) -> DataFrame:
    """``doc_id, terms, values``: each term's part of the score before its weight."""
    slack = F.lit(100 - LENGTH_SHARE).cast("bigint") + F.expr(f"(CAST({LENGTH_SHARE} AS BIGINT) * n * {documents}L) DIV {length}L")
    value = F.expr(f"transform(counts, c -> ({VALUE_UNIT}L * c) DIV ({SATURATION}L * c + {LENGTH_STEP}L * slack))")
    return vectors.withColumn("slack", slack).select("doc_id", "terms", value.alias("values"))


class Tree:
    """A ball tree over sparse vectors; nodes are ranges of ``order``, a node's left child is the next node."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, weight: np.ndarray, leaf: int):
        self.starts, self.terms, self.values, self.weight = starts, terms, values, weight
        self.order, self.low, self.high, self.right, self.centroids, self.radii = np.arange(len(starts) - 1), [], [], [], [], []
        self.points = values.astype(np.float64)
        self.squares = np.add.reduceat(self.points * self.points, starts[:-1])
        self.dense = np.zeros(len(weight))
        self._split(0, len(self.order), leaf)

    def _take(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of ``docs`` and where each document's begin."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[docs], sizes), ends - sizes

    def _products(self, at: np.ndarray, firsts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.points[at] * dense[self.terms[at]], firsts)

    def _distances(self, docs: np.ndarray, at: np.ndarray, firsts: np.ndarray, doc: int) -> np.ndarray:
        own = slice(self.starts[doc], self.starts[doc + 1])
        self.dense[self.terms[own]] = self.points[own]
        product = self._products(at, firsts, self.dense)
        self.dense[self.terms[own]] = 0.0
        return self.squares[docs] - 2 * product + self.squares[doc]

    def _split(self, low: int, high: int, leaf: int) -> None:
        node = len(self.low)
        docs = self.order[low:high]
        at, firsts = self._take(docs)
        self.low.append(low)
        self.high.append(high)
        self.right.append(None)
        centre = np.bincount(self.terms[at], self.points[at], len(self.weight)) / len(docs)
        far = (self.squares[docs] - 2 * self._products(at, firsts, centre) + centre @ centre).max()
        # Cancellation is bounded by the size of the squares.
        far += 1e-9 * (self.squares[docs].max() + centre @ centre)
        support = np.flatnonzero(centre)
        self.centroids.append((support, centre[support]))
        self.radii.append(np.sqrt(max(far, 0.0)) * (1 + 1e-9))
        if high - low <= leaf:
            return
        first = docs[np.argmax(self._distances(docs, at, firsts, docs[0]))]
        to_first = self._distances(docs, at, firsts, first)
        second = docs[np.argmax(to_first)]
        nearer = to_first - self._distances(docs, at, firsts, second)
        self.order[low:high] = docs[np.argsort(nearer, kind="stable")]
        # Where the nearer side ends, but neither side below an eighth, so that the tree stays shallow.
        eighth = (high - low) // 8
        middle = low + int(np.clip((nearer < 0).sum(), eighth + 1, high - low - eighth - 1))
        self._split(low, middle, leaf)
        self.right[node] = len(self.low)
        self._split(middle, high, leaf)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the products, nodes by items; ``queries`` has the items' weights, terms by items."""
        squares = queries * queries
        out = np.empty((len(self.low), queries.shape[1]))
        for node, ((support, centre), radius) in enumerate(zip(self.centroids, self.radii)):
            # Terms that no document below has add nothing: the ball lies in the space of the others.
            out[node] = centre @ queries[support] + np.sqrt(squares[support].sum(axis=0)) * radius
        return out * (1 + 1e-9) + 1.0

    def scores(self, node: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = self.order[self.low[node]:self.high[node]]
        at, firsts = self._take(docs)
        return docs, np.add.reduceat(self.values[at] * weights[self.terms[at]], firsts)


def _rank_key(score: int, doc_id: int | None) -> tuple[int, int, int]:
    """Larger is better: score, then smaller ids, null ids last."""
    return (score, 0, 0) if doc_id is None else (score, 1, -doc_id)


def search(tree: Tree, ids: list, queries: list[np.ndarray], best: list[list], k: int, scored: np.ndarray) -> None:
    """Best-first search of all items; ``best`` holds each item's heap of ``(rank key, doc_id)``."""
    for start in range(0, len(queries), BOUND_ITEMS):
        part = queries[start:start + BOUND_ITEMS]
        matrix = np.zeros((len(tree.weight), len(part)))
        for item, terms in enumerate(part):
            matrix[terms, item] = tree.weight[terms]
        bounds = tree.bounds(matrix)
        for item, terms in enumerate(part):
            weight = np.zeros(len(tree.weight), np.int64)
            weight[terms] = tree.weight[terms]
            scored[start + item] += search_item(tree, ids, weight, bounds[:, item].tolist(), best[start + item], k)


def search_item(tree: Tree, ids: list, weight: np.ndarray, bound: list[float], heap: list, k: int) -> int:
    """Search one item's best documents; the number of documents scored."""
    todo, scored = [(-bound[0], 0)], 0
    while todo:
        upper, node = heapq.heappop(todo)
        least = heap[0][0][0] if len(heap) == k else 1
        # At an equal score a smaller id still wins, so only lower bounds end the search.
        if -upper < least:
            break
        if tree.right[node] is not None:
            for child in (node + 1, tree.right[node]):
                heapq.heappush(todo, (-bound[child], child))
            continue
        docs, scores = tree.scores(node, weight)
        scored += len(docs)
        for at in np.flatnonzero(scores >= least).tolist():
            entry = (_rank_key(int(scores[at]), ids[docs[at]]), at, ids[docs[at]])
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry[0] > heap[0][0]:
                heapq.heapreplace(heap, entry)
    return scored


def block_matches(values: DataFrame, weight: np.ndarray, queries: list[np.ndarray], k: int, tree_docs: int) -> DataFrame:
    """Each task's best documents of each item; an item is the array of its terms' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in queries]
        seen, scored = 0, np.zeros(len(queries), np.int64)

        def tree_of(table: pa.Table) -> None:
            nonlocal seen
            seen += table.num_rows
            terms, entries = (table.column(c).combine_chunks() for c in ("terms", "values"))
            starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
            tree = Tree(starts, terms.flatten().to_numpy(), entries.flatten().to_numpy(), weight, LEAF_DOCS)
            search(tree, table.column("doc_id").to_pylist(), queries, best, k, scored)

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, tree_docs - rows)
                held.append(part)
                rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
                if rows == tree_docs:
                    tree_of(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            tree_of(pa.Table.from_batches(held))
        out = [(item, doc_id, key[0], seen, int(scored[item])) for item, heap in enumerate(best) for key, _, doc_id in heap]
        columns = list(zip(*out)) or [()] * 5
        names = ("item", "doc_id", "score", "seen", "scored")
        yield pa.RecordBatch.from_pydict({name: pa.array(column, pa.int64()) for name, column in zip(names, columns)})

    return values.mapInArrow(run, FOUND)


def _best(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy("item_id", *group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id",
                  text: str = "text", block_terms: int = BLOCK_TERMS, tree_docs: int = TREE_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0."""
    found = matches(docs, items, k, doc_id, item_id, text, block_terms, tree_docs)
    merged = _best(found.withColumn("tasks", F.floor(F.spark_partition_id() / MERGED_TASKS)), k, "tasks")
    return _best(merged, k).select("item_id", "rank", "doc_id", "score")


def matches(docs: DataFrame, items: DataFrame, k: int, doc_id: str, item_id: str, text: str, block_terms: int,
            tree_docs: int) -> DataFrame:
    """``item_id, doc_id, score, seen, scored``: what each task found, of how many documents, and how many it scored."""
    spark = docs.sparkSession
    pairs = written(item_blocks(item_terms(items, item_id, text), block_terms), "item-terms")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long, seen long, scored long")
    for row in pairs.select("block").distinct().orderBy("block").collect():
        listed = pairs.where(F.col("block") == row["block"]).select("item_id", "term").collect()
        vocabulary = sorted({r["term"] for r in listed})
        index = {t: i for i, t in enumerate(vocabulary)}
        names = sorted({r["item_id"] for r in listed}, key=lambda i: (i is None, i or 0))
        number = {name: i for i, name in enumerate(names)}
        queries: list[list[int]] = [[] for _ in names]
        for r in listed:
            queries[number[r["item_id"]]].append(index[r["term"]])
        vectors = written(document_vectors(docs, vocabulary, doc_id, text), "vectors")
        totals = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        if not totals["documents"]:
            continue
        weight = np.zeros(len(vocabulary), np.int64)
        for r in weights(vectors, totals["documents"]).collect():
            weight[r["term"]] = r["weight"]
        values = with_values(vectors.where(F.size("terms") > 0), totals["documents"], totals["length"])
        here = block_matches(values, weight, [np.array(q) for q in queries], k, tree_docs)
        item_names = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
        found = found.unionByName(here.join(F.broadcast(item_names), "item").drop("item"))
    return found
