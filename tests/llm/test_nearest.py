"""Nearest neighbours against brute force: exact scores, high recall, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from jobtrail.llm import nearest, queries
from tests.llm.odd import SMALL


def brute(ids, vectors, query, k):
    scores = (vectors * query[1]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query[0]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(found, ids, vectors, k):
    at = {int(i): v for i, v in zip(ids, vectors)}
    hit = total = 0
    for q, rows in found.items():
        want = brute(ids, vectors, (q, at[q]), k)
        assert len(rows) == len(want)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - float((at[q] * at[v]).sum())) < 1e-12 for v, s in rows)
        hit, total = hit + len({v for v, _ in rows} & {v for v, _ in want}), total + len(want)
    return hit / total


def test_query_recall(spark):
    rows = queries.table(spark, SMALL, "embeddings").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = by_query(queries.op5_nearest(spark, SMALL).collect())
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 20 == 0)
    assert recall(found, ids, vectors, 20) >= 0.95


def test_lengths_copies_and_parts(spark, monkeypatch):
    """Vectors of unlike lengths, many copies of one, several index parts and query blocks."""
    monkeypatch.setattr(nearest, "PART_VECTORS", 300)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2.0, size=(1500, 1))
    vectors[100:500] = vectors[100]
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    found = by_query(nearest.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect())
    assert recall(found, ids, vectors, 10) >= 0.95
    assert [v for v, _ in found[200]][:3] == [100, 101, 102] or found[200][0][1] > found[100][-1][1]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (40, []), (3, [0.0, 0.0]),
            (4, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]),
            (80, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<float>, part string, size int")
    found = by_query(nearest.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect())
    assert found == {0: [(20, 1.0), (1, 0.5)], 20: [(0, 1.0), (1, 0.5)]}
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_vectors_are_multiplied_in_double():
    """Single precision leaves a query little more than ``k`` vectors to verify in double, and the same rows come out."""
    class Watched(np.ndarray):
        rows = 0

        def __mul__(self, other):
            Watched.rows += len(self) if self.ndim == 2 else 0
            return np.asarray(self) * np.asarray(other)

    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(2000, 32)) / np.sqrt(32) * rng.uniform(0.5, 1.0, size=(2000, 1))
    vectors[10:40] = vectors[10]
    ids, asked = np.arange(2000), np.arange(0, 2000, 20)
    longest = float(np.sqrt((vectors * vectors).sum(axis=1)).max())
    query_ids, vector_ids, scores = nearest.search_part(ids, vectors.view(Watched), asked, vectors[asked], 20, longest)
    # The squares of all rows count once.
    assert Watched.rows <= len(ids) + len(asked) * 60
    hit = 0
    for q in asked:
        want, mine = brute(ids, vectors, (q, vectors[q]), 20), query_ids == q
        found = list(zip(vector_ids[mine].tolist(), scores[mine].tolist()))
        assert all(s == float((vectors[v] * vectors[q]).sum()) for v, s in found)
        hit += len(set(found) & set(want))
    assert hit >= 0.95 * 20 * len(asked)
