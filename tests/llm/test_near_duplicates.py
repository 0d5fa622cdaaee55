"""Near duplicates against all pairs of full sets, and components against a walk over the links."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import near_duplicates as nd, queries
from jobtrail.llm.components import components
from jobtrail.llm.shared import join_facts, join_places, place_of, places_of
from tests.llm.odd import SMALL, empty_frame, odd_frame

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    span = min(width, len(words))
    return frozenset(tuple(words[i:i + span]) for i in range(len(words) - span + 1))


def walk(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = walk(sets, links)
    return {i: (i, len(sets[i]), roots[i], roots[i] == i) for i in sets}


def same(frame, rows, width):
    assert sorted(map(tuple, frame.collect())) == sorted(brute(rows, width).values())


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in queries.table(spark, SMALL, "documents").collect()]
    same(queries.op4_near_duplicates(spark, SMALL), docs, 2)


def edits(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10 ** 6)}"
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_chains_groups_and_shared_passages(spark, width, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 16)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    base = rng.choices(vocabulary, k=200)
    chain = base
    for _ in range(30):
        chain = edits(rng, chain, 6 if width == 2 else 2)
        rows.append(" ".join(chain))
    rows += [" ".join(edits(rng, base, 3)) for _ in range(60)]
    passage = rng.choices(vocabulary, k=120)
    rows += [" ".join(passage + rng.choices(vocabulary, k=60)) for _ in range(80)]
    rows += [" ".join(base)] * 40 + [" ".join(base[:3])] * 3 + ["one", "ONE", "one two", "two one", "", " ", None]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(nd.near_duplicates(df, width=width), docs, width)


def test_links_of_different_components_in_a_bucket_are_found(spark):
    """A bucket's smallest member is near neither of two that are near each other."""
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = [f"g{g}_{i}" for i in range(100)]
        rows += [base[:74] + [f"x{g}_{i}" for i in range(26)], base, base[:98] + ["end", "here"]]
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(docs)
    same(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=2), docs, 2)


def test_odd_rows(spark):
    df = odd_frame(spark)
    got = nd.near_duplicates(df, width=5).collect()
    assert len(got) == df.count()
    known = {r.doc_id: tuple(r) for r in got if r.doc_id is not None}
    assert known == brute([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None], 5)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert nd.near_duplicates(empty_frame(spark)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(1)
    rows = []
    for similarity in (0.3, 0.5, 0.8, 0.9):
        for _ in range(40):
            n = 600
            common = round(n * similarity)
            values = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            half = (n - common) // 2
            a, b = np.unique(values[:common + half]), np.unique(np.concatenate([values[:common], values[common + half:]]))
            rows.append((similarity, nd.signature(nd.minima(a)).tolist(), nd.signature(nd.minima(b)).tolist()))
    df = spark.createDataFrame(rows, "s double, a array<long>, b array<long>")
    for r in df.groupBy("s").agg(F.avg(nd.estimate(F.col("a"), F.col("b"))).alias("mean"),
                                 F.min(nd.estimate(F.col("a"), F.col("b"))).alias("low")).collect():
        assert abs(r["mean"] - r["s"]) < 0.03
        assert r["s"] < 0.8 or r["low"] > nd.margin(0.8) + r["s"] - 0.8


def test_components(spark):
    rng = random.Random(2)
    nodes = list(range(300))
    links = [(i, i + 1) for i in range(0, 99)] + [(200, i) for i in range(201, 260)] \
        + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = walk({n for link in links if link[0] != link[1] for n in link}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("ends", [lambda i: (0, i), lambda i: (i, 500), lambda i: (250, i)])
def test_components_of_a_star(spark, ends):
    """One node with all links: the smallest, the largest, one between."""
    links = [ends(i) for i in range(1, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == walk({n for link in links if link[0] != link[1] for n in link}, links)


def test_a_hot_key_is_dealt_to_places(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("key"), "id")
    facts = rows.groupBy("key").agg(F.min("id").alias("low"), places_of("id", F.expr("id > 0")).alias("_places"))
    want = {(r.key, r.id): 0 if r.key == 7 else r.id for r in rows.where("id > 0").collect()}
    got = join_places(rows.where("id > 0"), facts, "key", "id").collect()
    assert len(got) == len(want) and {(r.key, r.id): r.low for r in got} == want
    assert {(r.key, r.id): r.low for r in join_facts(rows.where("id > 0"), facts.drop("_places"), "key", "id").collect()} == want
    dealt = rows.where("key = 7").groupBy(place_of("id")).count().collect()
    assert len(dealt) == 64 and max(r["count"] for r in dealt) < 100
