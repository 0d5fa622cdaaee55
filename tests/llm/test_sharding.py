"""Minimax cuts against brute force, and the shards' law."""

import zlib

import pytest
from hypothesis import given, settings, strategies as st

from jobtrail.llm import queries, sharding
from tests.llm.odd import SMALL, empty_frame, odd_frame


def brute_capacity(sizes, shards):
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    rows = [[float("inf")] * (shards + 1) for _ in ends]
    rows[0] = [0] * (shards + 1)
    for i in range(1, len(ends)):
        for k in range(1, shards + 1):
            rows[i][k] = min(max(rows[j][k - 1], ends[i] - ends[j]) for j in range(i))
    return rows[-1][shards]


@pytest.mark.parametrize("resolution", [4, 7, 20_000])
@pytest.mark.parametrize("sizes,shards", [
    ([5, 1, 9, 3, 3, 8, 2, 2, 7, 6, 1, 1], 4), ([16] * 30, 7), ([100, 1, 1, 1], 3), ([3], 5), ([1, 2, 50, 2, 1], 2),
    ([17, 91, 33, 64, 20, 20, 18, 300, 44, 16, 90, 71, 29, 16, 16, 250, 31, 77], 6),
])
def test_cuts(spark, sizes, shards, resolution):
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append((s, total))
    groups = spark.createDataFrame(ends, "bytes long, end long")
    capacity, cuts = sharding.minimax_cuts(groups, shards, resolution)
    assert capacity == brute_capacity(sizes, shards)
    borders = [0, *cuts, total]
    assert borders == sorted(borders) and set(cuts) <= {0, *[e for _, e in ends]}
    assert max(b - a for a, b in zip(borders, borders[1:])) == capacity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=14), st.integers(1, 5))
def test_even_cuts_keep_the_capacity(sizes, shards):
    ends = [sum(sizes[:i + 1]) for i in range(len(sizes))]
    totals = sharding._Totals(ends[-1])
    totals.refine(0, ends[-1], [(e, e, 1) for e in ends])
    capacity = sharding._smallest(totals, shards, max(sizes) - 1, ends[-1], False)
    assert capacity == brute_capacity(sizes, shards)
    borders = [0, *sharding._even_cuts(totals, capacity, shards), ends[-1]]
    assert all(0 <= b - a <= capacity for a, b in zip(borders, borders[1:]))


def check(rows, expected, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(expected)
    by = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def describe(doc_id, text):
    data = (text or "").encode()
    return doc_id, len(data) + 16, zlib.crc32(data)


def test_query(spark):
    docs = queries.table(spark, SMALL, "documents").collect()
    rows = queries.op7_shards(spark, SMALL).collect()
    check(rows, [describe(d.doc_id, d.text) for d in docs], 40)
    shard = {r.doc_id: r.shard for r in rows}
    texts = {}
    for d in docs:
        texts.setdefault(d.text, set()).add(shard[d.doc_id])
    assert all(len(s) == 1 for s in texts.values())
    first = {t: min(d.doc_id for d in docs if d.text == t) for t in texts}
    order = sorted(texts, key=first.get)
    sizes = [sum(len(d.text.encode()) + 16 for d in docs if d.text == t) for t in order]
    used = {}
    for r in rows:
        used[r.shard] = used.get(r.shard, 0) + r.size
    assert max(used.values()) == brute_capacity(sizes, 40)
    assert [shard[first[t]] for t in order] == sorted(shard[first[t]] for t in order)


def test_odd_rows(spark):
    df = odd_frame(spark).where("doc_id IS NOT NULL")
    rows = sharding.contiguous_shards(df, 3).collect()
    check(rows, [describe(r.doc_id, r.text) for r in df.collect()], 3)
    assert len(sharding.contiguous_shards(odd_frame(spark), 3).collect()) == odd_frame(spark).count()
    assert sharding.contiguous_shards(empty_frame(spark), 3).count() == 0
    assert {r.shard for r in sharding.contiguous_shards(df, 1).collect()} == {0}
