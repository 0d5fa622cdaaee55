"""Rows are led to the nodes of a tree's top, and only as far as they matter."""

import time

import numpy as np

from jobtrail.operators import forest


def test_rows_are_led_to_their_nodes():
    rng = np.random.default_rng(3)
    x, key = rng.integers(0, 32, (4000, 5)).astype(np.uint8), np.arange(4000, dtype=np.uint64)
    top = forest._Top()
    top.cuts = {1: (2, 3), 2: (0, 20), 3: (4, 10), 6: (1, 25), 13: (3, 5)}
    at = np.ones(len(x), dtype=int)
    for _ in range(4):
        at = np.array([2 * a + (x[r, top.cuts[a][0]] > top.cuts[a][1]) if a in top.cuts else a for r, a in enumerate(at)])
    shape = forest.Shape(5, 32, 2, 6, 1, 1.0, 42)
    drawn = shape.weights(key, 7)
    for nodes in ([26, 27], [4, 5, 7, 12, 26, 27], [5], [9]):
        rows, pos = top.place(x, 4, nodes)
        assert rows.tolist() == np.flatnonzero(np.isin(at, nodes)).tolist()
        assert np.array(nodes)[pos].tolist() == at[rows].tolist()
        some, where, w = top.drawn(shape, 7, key, x, 4, nodes)
        assert some.tolist() == [r for r in rows if drawn[r]] and w.tolist() == drawn[some].tolist()
        assert np.array(nodes)[where].tolist() == at[some].tolist()


def test_late_levels_follow_few_rows():
    """A top of few open nodes far down costs little more than the levels that lead most rows away."""
    x = np.random.default_rng(5).integers(0, 32, (1_000_000, 5)).astype(np.uint8)
    top = forest._Top()
    top.cuts = {(1 << k): (k % 5, 15) for k in range(14)}
    begin = time.perf_counter()
    rows, pos = top.place(x, 14, [1 << 14])
    assert time.perf_counter() - begin < 2
    assert len(rows) == ((x[:, :5] <= 15).all(1)).sum() and not pos.any()
