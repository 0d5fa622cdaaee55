"""Nodes of the prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from jobtrail.llm import prefix_trie, queries
from tests.llm.odd import SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, keys int, shard string, n string, low int, digest int, shared int"


def plain(sequences):
    """``sequences``: id -> list of (role, text)."""
    members, ends = {}, {}
    for conv, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    children = {node: 0 for node in members}
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = {n: 0 for n in members}, {n: 0 for n in members}
    for node, convs in members.items():
        own = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += own
    return sorted((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node],
                   saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
                  for node, convs in members.items())


def rebuilt(rows):
    """The query's sequences from ``(conv_id, turn, role, text)`` rows."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role, key, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def keyed(spark, sequences):
    rows = [(c, i, r, t) for c, turns in sequences.items() for i, (r, t) in enumerate(turns)]
    keys = prefix_trie.conversation_keys(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    empty = spark.createDataFrame([(c,) for c, turns in sequences.items() if not turns], "conv_id long")
    return keys.unionByName(empty.select("conv_id", F.array().cast("array<binary>").alias("keys")))


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], r[7]))


def random_sequences(seed, conversations, longest=7):
    rng = random.Random(seed)
    turns = [("user", "hot")] + [(rng.choice(["user", "bot"]), "é" * rng.randint(0, 9) + str(rng.randint(0, 3))) for _ in range(5)]
    return {rng.randint(-10**12, 10**12) if i % 3 else i: [rng.choice(turns[:1 + d]) if rng.random() < 0.9 else ("user", str(i))
            for d in range(rng.randint(0, longest))] for i in range(conversations)}


@pytest.mark.parametrize("shard_turns,sent", [(10**6, 50_000), (40, 50_000), (40, 0), (6, 50_000)])
def test_any_shards_give_the_plain_nodes(spark, shard_turns, sent, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SENT_NODES", sent)
    sequences = random_sequences(shard_turns, 60 if shard_turns == 6 else 300)
    got = prefix_trie.prefix_trie(keyed(spark, sequences), shard_turns).collect()
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(plain(sequences))


def test_copies_of_one_conversation(spark, monkeypatch):
    """A third of all conversations are one text; its ids are packed and hashed in order."""
    monkeypatch.setattr(prefix_trie, "PACKED_IDS", 7)
    sequences = random_sequences(2, 100) | {10**6 + 3 * i: [("user", "hot"), ("bot", "same")] for i in range(200)}
    got = prefix_trie.prefix_trie(keyed(spark, sequences), 100).collect()
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(plain(sequences))


def test_long_conversation(spark):
    sequences = {1: [("user", str(i)) for i in range(3000)], 2: [("user", str(i)) for i in range(2500)] + [("bot", "x")], 3: []}
    got = prefix_trie.prefix_trie(keyed(spark, sequences), 2000).collect()
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(plain(sequences))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=6), min_size=1, max_size=40))
def test_double_array_holds_exactly_the_prefixes(sequences):
    codes = np.array([c for s in sequences for c in s], np.int64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    trie = prefix_trie.DoubleArray(codes, np.cumsum(lengths) - lengths, lengths)
    states = {}
    for s in sequences:
        for depth, state in enumerate(trie.walk(np.array(s, np.int64))):
            assert states.setdefault(tuple(s[:depth]), state) == state
    assert len(set(states.values())) == len(states) == 1 + int((trie.check >= 0).sum())
    assert len(list(trie.levels())) == max(lengths) + 1


def test_odd_conversations(spark):
    rows = [(0, 1, "user", "a"), (0, None, "user", "first"), (0, 1, None, "b"), (0, 1, "user", "a"), (1, 0, "user", "first"),
            (1, None, None, None), (None, 3, "user", "lost"), (7, 0, "user", "é" * 50_000), (5, 2, "", ""), (-3, 1, "x", "y"),
            (-3, -5, "x", ""), (2**62, 0, "user", "a"), (11, 0, "1:", "a"), (12, 0, "", "1:a"), (11, 0, "1:", "a")]
    frame = spark.createDataFrame([(*r, 1, "s", "n", 2, 3, 4) for r in rows], SCHEMA)
    conv = F.col("conv_id")
    sequences = prefix_trie.with_heads_of(prefix_trie.conversation_keys(frame), conv - conv % 5,
                                          (F.crc32(conv.cast("string")) % 9).cast("int"), 8)
    got = prefix_trie.prefix_trie(sequences).collect()
    java = {c: c - int(np.fmod(c, 5)) for c in (-3,)}
    assert java[-3] == 0  # the remainder has the sign of the dividend, as in SQL
    want = rebuilt([r for r in rows if r[0] != -3])
    own = [("x", ""), ("x", "y")]
    h = zlib.crc32(b"-3") % 9
    first = [("user", "first"), ("", "b"), ("user", "a"), ("user", "a")]
    want[-3] = first[:h] + own[h:]
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(plain(want))
    assert prefix_trie.prefix_trie(prefix_trie.conversation_keys(frame.limit(0))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_prefix_trie(spark, SMALL)
    assert got.columns == COLUMNS
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain(rebuilt(rows)))
