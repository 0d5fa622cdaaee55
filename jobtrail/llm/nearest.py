"""Approximate nearest neighbours by counting collisions of one-dimensional projections.

Vectors are placed so that the largest inner product is the smallest distance:
a further component fills each up to the greatest length. An index part holds
some thousand vectors and, for each of ``PROJECTIONS`` random directions, the
array of its vectors sorted by projection. A query opens a window around its
own projection in every array and widens all windows step by step (virtual
rehashing with a growing radius). A vector's collisions are the windows that it
is in; those that exceed the threshold are verified by their inner product, in
single precision first and, as far as its error leaves them among the nearest,
exactly in double. A query stops widening when enough vectors have been verified that are
nearer than its radius, or when all have been.

Every vector is indexed and every query meets every part, in blocks of queries. The
work therefore grows as queries times vectors; memory is bounded by a part and a block.

Defined results: vectors null, empty, zero, or with a null or non-finite
component take no part, nor do rows without an id; of rows with one id the
smallest vector counts; vectors meet only those of their own length; ties go to
the smaller id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtrail.llm.shared import written

PROJECTIONS = 24
# A vector is verified when it lies in this share of the windows. One at a window's half-width lies in
# it with probability 0.68, so vectors within the radius exceed the share and those far beyond do not.
THRESHOLD = 0.6
FIRST_RADIUS, GROWTH = 0.5, 1.5
# Windows stop widening when so many times k verified vectors are within the radius.
ENOUGH = 1
PART_VECTORS, QUERY_BLOCK = 8_192, 4_096


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def directions(dimensions: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimensions, PROJECTIONS))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors in double precision."""
    joined = column.combine_chunks()
    return joined.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(joined), -1)


def _filled(vectors: np.ndarray, longest: float) -> np.ndarray:
    gap = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0.0))
    return np.concatenate([vectors, gap[:, None]], axis=1) / longest


def search_part(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest found of one part: query ids, vector ids and inner products."""
    axes = directions(vectors.shape[1] + 1)
    projected = _filled(vectors, longest) @ axes
    order = np.argsort(projected, axis=0, kind="stable").T
    sorted_values = np.take_along_axis(projected, order.T, axis=0).T
    lengths = np.sqrt((queries * queries).sum(axis=1))
    unit = np.concatenate([queries / lengths[:, None], np.zeros((len(queries), 1))], axis=1)
    at = unit @ axes
    needed = int(np.ceil(THRESHOLD * PROJECTIONS))
    # Window borders of all queries at each radius, one projection at a time.
    radii = [FIRST_RADIUS]
    while radii[-1] < 2.0:
        radii.append(radii[-1] * GROWTH)
    # Unsigned places wrap around below a window's lower border, so one comparison covers both borders.
    small = np.min_scalar_type(len(ids))
    place = np.empty(order.shape, dtype=small)
    np.put_along_axis(place, order, np.arange(len(ids), dtype=small)[None], axis=1)
    low = np.empty((len(radii), len(queries), PROJECTIONS, 1), dtype=small)
    width = np.empty_like(low)
    for j in range(PROJECTIONS):
        for r, radius in enumerate(radii):
            first = np.searchsorted(sorted_values[j], at[:, j] - radius, side="left")
            low[r, :, j, 0] = first
            width[r, :, j, 0] = np.searchsorted(sorted_values[j], at[:, j] + radius, side="right") - first
    # Single precision says which vectors can be among the nearest, ``slack`` is twice its error; those are verified in double.
    coarse, coarse_queries = (vectors / longest).astype(np.float32), (queries / lengths[:, None]).astype(np.float32)
    slack = 2.0 * (vectors.shape[1] + 4) * 2.0 ** -23
    out_q, out_v, out_s = [], [], []
    for q in range(len(queries)):
        guess = np.empty(len(ids), dtype=np.float32)
        known = ids == query_ids[q]
        own = np.flatnonzero(known)
        chosen = np.empty(0, dtype=np.int64)
        for r, radius in enumerate(radii):
            counts = np.add.reduce((place - low[r, q]) < width[r, q], axis=0, dtype=np.uint8)
            # Windows only widen, so what was guessed stays chosen.
            fresh = np.flatnonzero((counts >= needed) & ~known)
            if len(chosen) + len(fresh) < k and r + 1 < len(radii):
                continue
            guess[fresh] = coarse[fresh] @ coarse_queries[q]
            known[fresh] = True
            chosen = np.concatenate([chosen, fresh])
            if np.count_nonzero(2.0 - 2.0 * guess[chosen] <= radius * radius) >= ENOUGH * k:
                break
        if len(chosen) < k:
            # Fewer than k within the widest windows: all vectors of the part are verified.
            chosen = np.delete(np.arange(len(ids)), own)
            guess[chosen] = coarse[chosen] @ coarse_queries[q]
        if len(chosen) > k:
            guesses = guess[chosen]
            chosen = chosen[guesses >= np.partition(guesses, -k)[-k] - slack]
        # A row's products are summed in one order, so equal vectors have equal scores.
        scores = (vectors[chosen] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[chosen], -scores))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[chosen[best]])
        out_s.append(scores[best])
    empty = [np.empty(0)]
    return (np.concatenate(out_q or empty).astype(np.int64), np.concatenate(out_v or empty).astype(np.int64),
            np.concatenate(out_s or empty))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row among all other rows."""
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))) \
        .groupBy(F.col(id_column).cast("bigint").alias("vec_id")) \
        .agg(F.min(F.col(vector_column)).alias("vector"), F.max(is_query).alias("asks"))
    sized = written(rows.withColumn("size", F.size("vector")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # A row per vector length, of which there are few.
    facts = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("longest"),
                                      F.sum(F.col("asks").cast("long")).alias("n_queries"))
    known = sized.join(F.broadcast(facts) if facts.count() <= 1000 else facts, "size")
    parts = F.ceil(F.col("n") / F.lit(PART_VECTORS)).cast("int")
    blocks = F.ceil(F.col("n_queries") / F.lit(QUERY_BLOCK)).cast("int")
    part, block = F.pmod(F.xxhash64("vec_id"), parts).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks).cast("int")
    indexed = known.where("n_queries > 0").select(
        "size", part.alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "vec_id", "vector", "longest")
    asked = known.where("asks").select(
        (F.col("size") + F.lit(0)).alias("q_size"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q_part"), block.alias("q_block"),
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            found = search_part(left.column("vec_id").to_numpy(), _matrix(left.column("vector")),
                                right.column("query_id").to_numpy(), _matrix(right.column("query")), k,
                                left.column("longest")[0].as_py())
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    found = indexed.groupBy("size", "part", "block").cogroup(asked.groupBy("q_size", "q_part", "q_block")).applyInArrow(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
