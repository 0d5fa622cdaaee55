"""Prefix trie of conversations: double-array tries per shard, shared upper nodes merged.

1. Turns become keys: the SHA-256 of role and text, and the text's byte count.
   From here on no text is moved. A conversation is the array of its keys.
2. Equal conversations become one sequence with its count, so copies of one
   conversation are one row. Their ids are hashed in order as a stream.
3. Sequences are range-partitioned in their order into shards of about
   ``SHARD_TURNS`` turns, whatever their first turns are.
4. Each shard numbers its distinct turns densely, packs its trie into BASE and
   CHECK arrays, walks its sequences through the arrays for the nodes, and adds
   up subtrees along CHECK. As shards are ranges of one order, only nodes on
   the paths of a shard's first and last sequences can be in other shards too.
   Every sum is split so that it adds up over shards: a node is counted by the
   first shard that has it, and a shard knows the last sequence of the shard
   before it and the first of the one after it.
5. The shared upper nodes are summed by the digest of their path.

Bounds: a shard holds ``SHARD_TURNS`` keys of 40 bytes on average, and at least
one whole sequence; a conversation's keys are one array, so it may have some
millions of turns. Shared nodes number twice the shards times the depth at most.

Defined results: null roles and texts are empty; null turns come first; rows of
one conversation with the same turn number are ordered by role, then by digest;
repeated rows are repeated turns; rows without a conversation id belong to no
conversation; a conversation without turns ends at the root; an empty table has
no nodes. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.functions.frames import salted_join
from jobtrail.llm.shared import shuffle_parts, written

SHARD_TURNS = 200_000
# Ids of one sequence that are joined into one text before they are hashed in order.
PACKED_IDS = 4_096
# Up to this many shared nodes their lowest ids travel to every task.
SENT_NODES = 50_000
KEY_BYTES = 40
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
NODES = ("digest binary, parent_digest binary, conv_id long, parent_conv_id long, depth long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shared boolean")


def turn_key(role: Column, text: Column) -> Column:
    """The SHA-256 of role and text, then the text's length in UTF-8 bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.sha2(whole, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def conversation_keys(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
                      role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``conv_id, keys``: each conversation's turn keys in order."""
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(role_column, F.lit("")).alias("role"),
                    turn_key(F.col(role_column), F.col(text_column)).alias("key"))
    listed = rows.where(F.col(conv_column).isNotNull()).groupBy(F.col(conv_column).alias("conv_id")) \
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.col("turns.key").alias("keys"))


def with_heads_of(sequences: DataFrame, source: Column, length: Column, longest: int) -> DataFrame:
    """Replace each conversation's first ``length`` turns by those of the conversation ``source``, if there is one."""
    heads = sequences.select(F.col("conv_id").alias("head_id"), F.slice("keys", 1, longest).alias("head"))
    joined = sequences.withColumn("head_of", source).join(heads, F.col("head_of") == F.col("head_id"), "left")
    none = F.array().cast("array<binary>")
    tail = F.slice("keys", length + 1, F.greatest(F.size("keys") - length, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), length), tail).alias("keys"))


def _pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the ids of each sequence, in the order they come, into texts of ``PACKED_IDS`` ids at most."""
    now, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"sequence": pa.array([now], pa.string()), "first_id": pa.array([ids[0]], pa.int64()),
                                           "ids": pa.array([",".join(map(str, ids))], pa.string())})

    for batch in batches:
        for sequence, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (sequence != now or len(ids) == PACKED_IDS):
                yield row()
                ids = []
            now = sequence
            ids.append(conv)
    if ids:
        yield row()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"sequence": pa.array([now], pa.string()),
                                           "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    for batch in batches:
        for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if sequence == now:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                yield row()
            now, digest = sequence, hashlib.sha256(ids.encode())
    if digest is not None:
        yield row()


def end_hashes(ends: DataFrame) -> DataFrame:
    """``sequence, ends_sha256``: the hash of all ids of a sequence, ascending and comma-joined, from ``sequence, conv_id``.

    Ids are sorted globally and joined where they lie, so the task that hashes a
    sequence of many copies reads one row for thousands of ids.
    """
    parts = shuffle_parts(ends.sparkSession)
    by_range = ends.select("sequence", "conv_id").repartitionByRange(parts, "sequence", "conv_id") \
        .sortWithinPartitions("sequence", "conv_id")
    packed = by_range.mapInArrow(_pack_ids, "sequence string, first_id long, ids string")
    dealt = packed.repartition(parts, "sequence").sortWithinPartitions("sequence", "first_id")
    return dealt.mapInArrow(_hash_ids, "sequence string, ends_sha256 string")


class DoubleArray:
    """A trie over dense codes in two arrays.

    The child of state ``s`` by code ``c`` is slot ``BASE[s] + c`` if ``CHECK``
    of that slot is ``s``. State 0 is the root.
    """

    TRIES = 32

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.codes, self.starts, self.lengths = codes, starts, lengths
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self.used = np.ones(1, bool)
        alphabet = int(codes.max()) + 1 if len(codes) else 1
        rows, state = np.flatnonzero(lengths > 0), np.zeros(int((lengths > 0).sum()), np.int64)
        depth = 0
        while len(rows):
            # The distinct (state, code) pairs of this depth, grouped by state.
            pairs, back = np.unique(state * alphabet + codes[starts[rows] + depth], return_inverse=True)
            parents, code = pairs // alphabet, pairs % alphabet
            self._place(parents, code)
            slots = self.base[parents] + code
            state = slots[back.reshape(-1)]
            depth += 1
            on = lengths[rows] > depth
            rows, state = rows[on], state[on]

    def _grow(self, size: int) -> None:
        more = size - len(self.used)
        if more > 0:
            more = max(more, len(self.used) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def _place(self, parents: np.ndarray, code: np.ndarray) -> None:
        """Choose BASE for each parent so that its children's slots are free."""
        states, first, count = np.unique(parents, return_index=True, return_counts=True)
        for at in np.flatnonzero(count > 1):
            own = code[first[at]:first[at] + count[at]]
            free = np.flatnonzero(~self.used)[:self.TRIES]
            base = len(self.used) - own[0]
            for slot in free:
                places = slot + own - own[0]
                inside = places[places < len(self.used)]
                if not self.used[inside].any():
                    base = slot - own[0]
                    break
            self._take(states[at], base, own)
        single = np.flatnonzero(count == 1)
        if len(single):
            self._grow(len(self.used) + max(0, len(single) - int((~self.used).sum())))
            slots = np.flatnonzero(~self.used)[:len(single)]
            self.base[states[single]] = slots - code[first[single]]
            self.check[slots], self.used[slots] = states[single], True

    def _take(self, state: int, base: int, own: np.ndarray) -> None:
        self._grow(int(base + own[-1]) + 1)
        self.base[state] = base
        self.check[base + own], self.used[base + own] = state, True

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Walk all sequences through the arrays: rows still on their way, and their states, depth by depth."""
        rows, state, depth = np.arange(len(self.lengths)), np.zeros(len(self.lengths), np.int64), 0
        while len(rows):
            yield rows, state
            on = self.lengths[rows] > depth
            rows, state = rows[on], state[on]
            slots = self.base[state] + self.codes[self.starts[rows] + depth]
            if not (self.check[slots] == state).all():
                raise AssertionError("a sequence left the trie")
            state, depth = slots, depth + 1

    def walk(self, codes: np.ndarray) -> list[int]:
        states = [0]
        for code in codes:
            states.append(int(self.base[states[-1]] + code))
        return states


def common_prefix(left: list[bytes] | None, right: list[bytes] | None) -> int:
    """Turns two sequences have in common; -1 if one of them does not exist."""
    if left is None or right is None:
        return -1
    return next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))


def shard_nodes(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """The nodes of a shard; ``bounds`` has the sequences at its ends and next to them."""
    keys = rows.column("keys").combine_chunks()
    lengths = pc.list_value_length(keys).to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    coded = pc.dictionary_encode(keys.flatten())
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64)
    size = np.array([int.from_bytes(k[-8:], "big") for k in names], np.int64)
    code_of = {k: i for i, k in enumerate(names)}
    count, low = rows.column("n").to_numpy(), rows.column("low").to_numpy()
    first, last, before, after = (bounds.column(c)[0].as_py() for c in ("first", "last", "before", "after"))

    trie = DoubleArray(codes, starts, lengths)
    slots = len(trie.check)
    n = np.zeros(slots, np.int64)
    lowest = np.full(slots, np.iinfo(np.int64).max)
    depth_of = np.zeros(slots, np.int64)
    weight = np.zeros(slots, np.int64)
    end_of = np.full(slots, -1, np.int64)
    by_depth = []
    for depth, (at, state) in enumerate(trie.levels()):
        np.add.at(n, state, count[at])
        np.minimum.at(lowest, state, low[at])
        if depth:
            weight[state] = size[codes[starts[at] + depth - 1]]
        ended = lengths[at] == depth
        end_of[state[ended]] = at[ended]
        states = np.unique(state)
        depth_of[states] = depth
        by_depth.append(states)

    shared_before, shared_after = common_prefix(before, first), common_prefix(last, after)
    first_path = trie.walk(np.array([code_of[k] for k in first], np.int64))
    last_path = trie.walk(np.array([code_of[k] for k in last], np.int64))
    owned, shared, digest = np.ones(slots, bool), np.zeros(slots, bool), {}
    owned[first_path[:shared_before + 1]] = False
    for path, sequence, common in ((first_path, first, shared_before), (last_path, last, shared_after)):
        shared[path[:common + 1]] = True
        code = hashlib.sha256(b"").digest()
        for depth in range(common + 1):
            code = hashlib.sha256(code + sequence[depth - 1]).digest() if depth else code
            digest[path[depth]] = code

    inner = np.zeros(slots, bool)
    for states in by_depth[1:]:
        inner[trie.check[states]] = True
    extended = last_path[-1] if shared_after == len(last) else -1
    leaves = np.zeros(slots, np.int64)
    everyone = np.concatenate(by_depth)
    leaves[everyone] = ~inner[everyone]
    if extended >= 0:
        leaves[extended] = 0
    saved = n * weight - owned * weight
    children = np.zeros(slots, np.int64)
    for states in by_depth[:0:-1]:
        above = trie.check[states]
        np.add.at(children, above, owned[states].astype(np.int64))
        np.add.at(leaves, above, leaves[states])
        np.add.at(saved, above, saved[states])

    hashes = rows.column("ends_sha256").to_pylist()
    above = trie.check[everyone]
    tops = [digest.get(p) if p >= 0 else None for p in above.tolist()]
    known = np.array([p >= 0 and t is None for p, t in zip(above.tolist(), tops)], bool)
    return pa.table({
        "digest": pa.array([digest.get(s) for s in everyone.tolist()], pa.binary()),
        "parent_digest": pa.array(tops, pa.binary()),
        "conv_id": pa.array(lowest[everyone]),
        "parent_conv_id": pa.array(lowest[np.maximum(above, 0)], mask=~known),
        "depth": pa.array(depth_of[everyone]), "n_convs": pa.array(n[everyone]),
        "n_children": pa.array(children[everyone]), "n_leaves": pa.array(leaves[everyone]),
        "saved_tokens": pa.array(saved[everyone]),
        "ends_sha256": pa.array([hashes[e] if e >= 0 else None for e in end_of[everyone].tolist()], pa.string()),
        "shared": pa.array(shared[everyone])})


def sequence_shards(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Distinct sequences with count, lowest id and hash of ids, dealt into shards that are ranges of their order."""
    named = sequences.select("conv_id", "keys", F.sha2(F.concat_ws("", F.transform("keys", F.hex)), 256).alias("sequence"))
    named = written(named, "sequences")
    hashes = end_hashes(named)
    distinct = named.groupBy("sequence").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"),
                                             F.min("conv_id").alias("low"))
    distinct = written(distinct.join(hashes, "sequence").drop("sequence"), "distinct-sequences")
    turns = distinct.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    parts = max(1, -(-turns // shard_turns))
    dealt = distinct.repartitionByRange(parts, "keys").withColumn("shard", F.spark_partition_id())
    return written(dealt, "shards")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per distinct prefix of the conversations in ``conv_id, keys`` (one row per conversation)."""
    from pyspark.sql import Window

    shards = sequence_shards(sequences, shard_turns)
    ends = shards.groupBy("shard").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    order = Window.orderBy("shard")  # one row per shard
    bounds = ends.select("shard", "first", "last", F.lag("last").over(order).alias("before"),
                         F.lead("first").over(order).alias("after"))
    nodes = shards.groupBy("shard").cogroup(bounds.groupBy("shard")).applyInArrow(shard_nodes, NODES)
    nodes = written(nodes, "trie-nodes")

    upper = nodes.where("shared").groupBy("digest").agg(
        F.first("parent_digest").alias("parent_digest"), F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"))
    upper = written(upper, "upper-nodes")
    lowest = upper.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("upper_conv_id"))
    merged = nodes.where("NOT shared").drop("shared").unionByName(upper)
    below = merged.where("parent_digest IS NOT NULL")
    if upper.count() <= SENT_NODES:
        below = below.join(F.broadcast(lowest), "parent_digest")
    else:
        below = salted_join(below, lowest, ["parent_digest"], ["conv_id", "depth"])
    below = below.withColumn("parent_conv_id", F.col("upper_conv_id")).select(*merged.columns)
    return merged.where("parent_digest IS NULL").unionByName(below).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"))
