"""Minimax contiguous sharding of ordered atomic groups.

Groups are the documents of one text, ordered by their smallest document id.
The smallest feasible capacity is found by binary search; a capacity is
checked greedily on the running totals of the group sizes. The driver never
holds the totals of all groups: it keeps some of them, and for the open gaps
between those a check is run both as if nothing and as if everything could be
cut there. Where the two answers differ, one job fetches finer totals of just
the regions in doubt. Each round narrows the regions by the resolution, so a
few rounds reach the exact capacity for any number of groups.

Defined results: a null text has size ``overhead`` and is a group of its own
kind; null document ids order by a hash; equal rows stay separate rows; extra
columns are ignored; an empty table gives no rows; a group larger than the even
share makes the capacity, and fewer groups than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from jobtrail.llm.shared import written
from jobtrail.operators.scan import Scan, key_scan

# Totals fetched in one round.
RESOLUTION = 20_000


class _Totals:
    """Some of the groups' running totals; ``open_before[i]`` says that others lie between i-1 and i."""

    def __init__(self, total: int):
        self.ends = np.array([0, total], dtype=np.int64)
        self.open_before = np.array([False, True])

    def below(self, x: int) -> int:
        """The largest known total up to x."""
        return int(self.ends[np.searchsorted(self.ends, x, side="right") - 1])

    def at_most(self, x: int) -> int:
        """No total up to x is larger than this."""
        i = int(np.searchsorted(self.ends, x, side="right"))
        return x if i < len(self.ends) and self.open_before[i] else int(self.ends[i - 1])

    def refine(self, low: int, high: int, slices: list[tuple[int, int, int]]) -> None:
        """Replace what is known inside (low, high] by the first, last and number of totals of its slices."""
        keep = (self.ends <= low) | (self.ends > high)
        ends, opens = [], []
        for first, last, count in slices:
            ends += [first, last] if count > 1 else [first]
            opens += [False, count > 2] if count > 1 else [False]
        merged = np.concatenate([self.ends[keep], np.array(ends, dtype=np.int64)])
        flags = np.concatenate([self.open_before[keep], np.array(opens, dtype=bool)])
        order = np.argsort(merged, kind="stable")
        self.ends, self.open_before = merged[order], flags[order]


def _greedy(totals: _Totals, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Where shards end if each takes all it can; ends early when a group does not fit."""
    find, cuts = (totals.at_most if hopeful else totals.below), [0]
    for _ in range(shards):
        cuts.append(find(min(cuts[-1] + capacity, int(totals.ends[-1]))))
    return cuts


def _smallest(totals: _Totals, shards: int, low: int, high: int, hopeful: bool) -> int:
    """Smallest feasible capacity in low+1..high; ``high`` is feasible."""
    while high - low > 1:
        middle = (low + high) // 2
        if _greedy(totals, middle, shards, hopeful)[-1] == totals.ends[-1]:
            high = middle
        else:
            low = middle
    return high


def _fetch(groups: DataFrame, regions: list[tuple[int, int]], resolution: int) -> list[tuple]:
    """Per region the first, last and number of the totals in each of its slices."""
    slices = max(2, resolution // len(regions))
    region = F.lit(None).cast("int")
    width, start = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for i, (low, high) in enumerate(regions):
        inside = (F.col("end") > low) & (F.col("end") <= high)
        region = F.when(inside, F.lit(i)).otherwise(region)
        start = F.when(inside, F.lit(low).cast("bigint")).otherwise(start)
        width = F.when(inside, F.lit(-(-(high - low) // slices)).cast("bigint")).otherwise(width)
    found = groups.select("end", region.alias("region"), start.alias("start"), width.alias("width")) \
        .where("region IS NOT NULL") \
        .groupBy("region", F.expr("(end - start - 1) div width").alias("slice")) \
        .agg(F.min("end"), F.max("end"), F.count(F.lit(1))).collect()
    return [tuple(r) for r in found]


def minimax_cuts(groups: DataFrame, shards: int, resolution: int = RESOLUTION) -> tuple[int, list[int]]:
    """Smallest capacity, and the ends of the first ``shards - 1`` shards.

    ``groups`` has a row per group with its positive ``bytes`` and running
    total ``end``. Cuts keep within the capacity and, inside that, near even.
    """
    total, largest = groups.agg(F.max("end"), F.max("bytes")).first()
    if not total:
        return 0, [0] * (shards - 1)
    totals, regions = _Totals(total), [(0, total)]
    low, high = max(-(-total // shards), largest) - 1, total
    while True:
        found = _fetch(groups, regions, resolution)
        for i, (start, end) in enumerate(regions):
            totals.refine(start, end, [slice_[2:] for slice_ in found if slice_[0] == i])
        high = _smallest(totals, shards, low, high, hopeful=False)
        low = _smallest(totals, shards, low, high, hopeful=True) - 1
        if high - low <= 1:
            return high, _even_cuts(totals, high, shards)
        regions = _doubtful(totals, _greedy(totals, low + 1, shards, False), _greedy(totals, high, shards, True))


def _doubtful(totals: _Totals, early: list[int], late: list[int]) -> list[tuple[int, int]]:
    """Merged runs of open gaps that hold a place between the earliest and latest a shard may end."""
    spans = []
    for a, b in sorted(zip(early, late)):
        first = max(0, int(np.searchsorted(totals.ends, a, side="right")) - 1)
        last = min(len(totals.ends) - 1, int(np.searchsorted(totals.ends, b, side="left")))
        gaps = [i for i in range(first + 1, last + 1) if totals.open_before[i]]
        if gaps:
            spans.append((int(totals.ends[gaps[0] - 1]), int(totals.ends[gaps[-1]])))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _even_cuts(totals: _Totals, capacity: int, shards: int) -> list[int]:
    """Cuts near even shares among those that keep every shard within ``capacity``."""
    total = int(totals.ends[-1])
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(int(totals.ends[np.searchsorted(totals.ends, max(0, earliest[-1] - capacity))]))
    earliest = earliest[::-1]
    cuts = [0]
    for j in range(1, shards):
        wanted = max(earliest[j - 1], j * total // shards)
        cuts.append(totals.below(min(cuts[-1] + capacity, wanted)))
    return cuts[1:]


def contiguous_shards(docs: DataFrame, shards: int, overhead: int = 16, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """Place every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the text's UTF-8 bytes plus ``overhead``. Slots of a shard go by
    document id from 0. The law is ``bytes``: sizes near equal, so another
    shard count means another placement and ``grown_shard`` is null.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(overhead)).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"null")).alias("_key"))
    groups = rows.groupBy("_key").agg(
        F.coalesce(F.min("doc_id"), F.shiftright(F.xxhash64("_key"), 2)).alias("_first"), F.sum("size").alias("bytes"))
    # Read by every round of the search and by the placement.
    ends = written(key_scan(groups, "_first", [Scan("end", "sum", "bytes")], order=["_key"])
                   .select("_key", "bytes", "end"), "shard-totals")
    _, cuts = minimax_cuts(ends, shards)
    end_of_shard = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    shard = F.size(F.filter(end_of_shard, lambda c: c < F.col("end")))
    placed = rows.join(ends.select("_key", shard.alias("shard")), "_key").select(
        "doc_id", "size", "text_crc32", "shard", F.lit(1).cast("bigint").alias("_one"),
        F.coalesce("doc_id", F.shiftright(F.xxhash64("_key"), 2)).alias("_order"))
    slots = key_scan(placed, "_order", [Scan("slot", "sum", "_one", before=True)], by=["shard"],
                     order=["text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
