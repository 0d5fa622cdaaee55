"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from jobtrail.llm import ball_tree, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame, odd_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id int, score string, rank int, term int, block string, item int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """``docs``: (id, text) rows; ``items``: (id, text) rows."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n_docs // length
            score = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "s", 1, 2, "b", 3) for i, t in items], ITEMS)


ODD_ITEMS = [(1, "One two three"), (1, "the end"), (None, "no id here"), (2, None), (3, ""), (4, "$$$"), (5, "THE thE é ß"), (6, "zebra unknown"),
             (7, " ".join(f"w{i}" for i in range(5000)) + " ing"), (8, "你好"), (5, "the")]


@pytest.mark.parametrize("block_terms,tree_docs", [(20_000, 8_192), (2_600, 5)])
def test_odd_documents(spark, block_terms, tree_docs):
    docs = [tuple(r) for r in odd_frame(spark).select("doc_id", "text").collect()]
    got = ball_tree.ranked_search(odd_frame(spark), item_frame(spark, ODD_ITEMS), 4, block_terms=block_terms, tree_docs=tree_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == plain(docs, ODD_ITEMS, 4)


def test_empty_tables(spark):
    assert ball_tree.ranked_search(empty_frame(spark), item_frame(spark, ODD_ITEMS)).count() == 0
    assert ball_tree.ranked_search(odd_frame(spark), item_frame(spark, ODD_ITEMS[3:6])).count() == 0
    assert ball_tree.ranked_search(odd_frame(spark), item_frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_documents_with_ties(spark, seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1] + " t3") for i in range(300)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 8)))) for i in range(25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ball_tree.ranked_search(frame, item_frame(spark, items), 20, tree_docs=(64, 200, 8192)[seed])
    assert found(got) == plain(docs, items, 20)


def test_bounds_hold_for_every_document():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 500)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows = [np.sort(rng.choice(80, s, replace=False)) for s in sizes]
    values = rng.integers(1, 10**6, starts[-1])
    weight = rng.integers(0, 20_000, 80)
    tree = ball_tree.Tree(starts, np.concatenate(rows).astype(np.int32), values, weight, 8)
    queries_ = np.where(rng.random((80, 40)) < 0.1, weight[:, None], 0)
    bounds = tree.bounds(queries_.astype(float))
    assert sorted(tree.order) == list(range(500))
    for node in range(len(tree.low)):
        for item in range(40):
            _, scores = tree.scores(node, queries_[:, item])
            assert scores.max() <= bounds[node, item]


def test_clustered_documents_are_pruned(spark):
    """Topics with words of their own: most documents are never scored."""
    rng = random.Random(1)
    docs = [(i, " ".join(f"topic{i % 40}x{rng.randint(0, 15)}" for _ in range(40))) for i in range(4000)]
    items = [(i, f"topic{i}x0 topic{i}x1 topic{i}x2") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = ball_tree.matches(frame, item_frame(spark, items), 10, "doc_id", "item_id", "text", 20_000, 8_192).collect()
    share = {r.item_id: r.scored / r.seen for r in rows}
    assert len(share) == 40 and sum(share.values()) / 40 < 0.25


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(queries.op13_ranked_search(spark, SMALL)) == plain(docs, items, 50)
    assert len(odd_texts()) > 10
