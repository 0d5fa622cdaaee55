"""Ordered scans (running sum, maximum, last value, ordinal) without a single-task window.

Rows are cut into ordered blocks. Every block is scanned on its own, the block
totals are scanned to get what each block inherits, and the two are combined.

* ``key_scan`` takes frames with few rows per (group, integer key): the block is
  the key without its low bits. A block holds at most 2**LEAF_BITS keys, a
  parent at most 2**PARENT_BITS blocks and the top at most
  2**(64 - LEAF_BITS - PARENT_BITS) parents, whatever the data; there is one
  plan for every size. Callers aggregate rows of one key first, so a hot
  instant is one row here.
* ``in_blocks`` and what builds on it scan rows in the order of several
  integers. A group that fits one task is one block. Borders of larger groups
  are found once along the whole composite order, so a value that most rows share
  is many blocks, and are constants from then on: totals and rows see one
  deterministic cut, rows are shuffled once, and nothing is written in between.
* ``text_ordinal`` numbers distinct texts, which have no bounded integer key:
  they are range-partitioned, and the cut is written to the shared folder
  because the blocks' counts and the numbering must see the same one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from jobtrail.functions.frames import attach
from jobtrail.operators.checkpoints import materialise

LEAF_BITS = 22
PARENT_BITS = 20
BLOCK = "_block"


@dataclass(frozen=True)
class Scan:
    """One running column: ``op`` is sum, max, last (non-null) or total (whole group)."""

    name: str
    op: str
    column: str
    before: bool = False  # leave the current row out


def _block_value(scan: Scan, order: Sequence[str]) -> Column:
    c = F.col(scan.column)
    if scan.op in ("sum", "total"):
        return F.sum(c)
    if scan.op == "max":
        return F.max(c)
    if scan.op == "last":
        position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
        return F.max_by(c, F.when(c.isNotNull(), position))
    raise ValueError(f"Unknown scan: {scan.op!r}")


def _running(scan: Scan, column: str, window, before: bool) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    c = F.col(column)
    if scan.op == "sum":
        return F.sum(c).over(frame)
    if scan.op == "max":
        return F.max(c).over(frame)
    return F.last(c, ignorenulls=True).over(frame)


def _combine(scan: Scan, inherited: Column, local: Column) -> Column:
    if scan.op == "sum":
        return F.coalesce(inherited, F.lit(0)) + F.coalesce(local, F.lit(0))
    if scan.op == "max":
        return F.greatest(inherited, local)
    return F.coalesce(local, inherited)


def _inherited(blocks: DataFrame, by: Sequence[str], scans: Sequence[Scan], widths: Sequence[int]) -> DataFrame:
    """For each block the scan over all earlier blocks of its group (columns ``_h_*``)."""
    if not widths:
        within = Window.partitionBy(*by).orderBy(BLOCK)
        whole = Window.partitionBy(*by)
        return blocks.select(*by, BLOCK, *[
            (F.sum(f"_v_{s.name}").over(whole) if s.op == "total"
             else _running(s, f"_v_{s.name}", within, True)).alias(f"_h_{s.name}")
            for s in scans
        ])
    width, higher = widths[0], widths[1:]
    children = blocks.withColumn("_parent", F.shiftright(BLOCK, width))
    parents = children.groupBy(*by, "_parent").agg(*[
        _block_value(Scan(s.name, s.op, f"_v_{s.name}"), [BLOCK]).alias(f"_v_{s.name}") for s in scans
    ]).withColumnRenamed("_parent", BLOCK)
    above = _inherited(parents, by, scans, higher).select(
        *by, F.col(BLOCK).alias("_parent"), *[F.col(f"_h_{s.name}").alias(f"_u_{s.name}") for s in scans])
    within = Window.partitionBy(*by, "_parent").orderBy(BLOCK)
    local = children.select(*by, BLOCK, "_parent", *[
        _running(s, f"_v_{s.name}", within, True).alias(f"_l_{s.name}") for s in scans if s.op != "total"
    ])
    return local.join(above, [*by, "_parent"]).select(*by, BLOCK, *[
        (F.col(f"_u_{s.name}") if s.op == "total"
         else _combine(s, F.col(f"_u_{s.name}"), F.col(f"_l_{s.name}"))).alias(f"_h_{s.name}")
        for s in scans
    ])


def solid_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Stand-ins without nulls for nullable group columns, so that plain equality keeps null groups.

    Window, totals and join then agree on one partitioning of the rows.
    """
    keys, added = [], {}
    for i, field in enumerate(df.schema[c] for c in by):
        if not field.nullable:
            keys.append(field.name)
            continue
        value = F.col(field.name)
        if isinstance(field.dataType, T.NumericType):
            added[f"_g{i}"] = F.coalesce(value, F.lit(0).cast(field.dataType))
        else:
            added[f"_g{i}"] = F.coalesce(value.cast("string"), F.lit(""))
        added[f"_n{i}"] = value.isNull()
        keys += [f"_g{i}", f"_n{i}"]
    return (df.withColumns(added) if added else df), keys


def block_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], scans: Sequence[Scan],
                 widths: Sequence[int] = ()) -> DataFrame:
    """Per block: its own value (``_v_*``) and what it inherits (``_h_*``); ``by`` has no nulls."""
    values = df.groupBy(*by, BLOCK).agg(*[_block_value(s, order).alias(f"_v_{s.name}") for s in scans])
    return values.join(_inherited(values, by, scans, widths), [*by, BLOCK])


def _scan_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Sequence[Scan],
                 widths: Sequence[int], keep: Sequence[str]) -> DataFrame:
    # Counting the order's columns lets totals and rows of a narrow frame read one and the same exchange.
    seen = reduce(lambda a, b: a + b, [F.count(c) for c in order])
    values = df.groupBy(*keys, BLOCK).agg(
        seen.alias("_seen"), *[_block_value(s, order).alias(f"_v_{s.name}") for s in scans])
    carried = _inherited(values.where(F.col("_seen") >= 0), keys, scans, widths)
    window = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = df.select("*", *[
        _running(s, s.column, window, s.before).alias(f"_l_{s.name}") for s in scans if s.op != "total"
    ])
    # One carried row per block: hashing that side leaves the rows where they are.
    joined = local.join(carried.hint("shuffle_hash"), [*keys, BLOCK])
    return joined.select(*keep, *[
        (F.col(f"_h_{s.name}") if s.op == "total"
         else _combine(s, F.col(f"_h_{s.name}"), F.col(f"_l_{s.name}"))).alias(s.name)
        for s in scans
    ])


def with_key_blocks(df: DataFrame, key: str) -> tuple[DataFrame, tuple[int, ...]]:
    """Add the block of each key; also returns the widths of the levels above the blocks."""
    block = F.coalesce(F.shiftright(F.col(key).cast("bigint"), LEAF_BITS), F.lit(0).cast("bigint"))
    return df.withColumn(BLOCK, block), (PARENT_BITS,)


def key_scan(df: DataFrame, key: str, scans: Sequence[Scan], by: Sequence[str] = (),
             order: Sequence[str] = ()) -> DataFrame:
    """Scan a frame holding few rows per (group, integer key), ordered by the key.

    ``order`` names finer columns that agree with the key (for example the
    DOUBLE the key was made from).
    """
    blocked, widths = with_key_blocks(df, key)
    solid, keys = solid_keys(blocked, by)
    return _scan_blocks(solid.repartition(*keys, BLOCK), keys, [key, *order], scans, widths, df.columns)


# Where rows without a value stand in an order: first.
FIRST = -(1 << 62)
# Rows of a block: with groups, and without (where blocks are all the parallelism there is).
GROUP_ROWS, WHOLE_ROWS, MOST_ROWS = 1 << 16, 1 << 12, 1 << 20
# Borders are held by every task; beyond this many of them blocks grow instead.
MOST_BORDERS = 200_000


@dataclass(frozen=True)
class Blocked:
    """Rows with their block: ``keys`` and ``order`` name stand-ins without nulls, ``cut`` says if any group has several blocks."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool

    def window(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all; one small job."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return found[0] or 0, found[1] or 0


def _block_rows(by: Sequence[str], whole: int) -> int:
    least, parts = (GROUP_ROWS, 64) if by else (WHOLE_ROWS, 16)
    return max(min(max(whole // parts, least), MOST_ROWS), whole // MOST_BORDERS)


def order_borders(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int) -> list[tuple]:
    """``(group, borders)`` for groups of more than ``block_rows`` rows; a border is the first place of a block.

    Approximate percentiles of the first order column cut a group; a value that
    fills a block by itself is cut by the next column. The borders decide how
    even the blocks are, never a result.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).collect()
    open_items = [(tuple(r[:-1]), (), r["n"]) for r in sizes]
    borders: dict[tuple, set] = {item[0]: set() for item in open_items}
    fields = [rows.schema[k] for k in keys]
    for level, column in enumerate(order):
        hot = []
        # Items that want about as many parts share one pass.
        classes: dict[int, list] = {}
        for item in open_items:
            classes.setdefault((-(-item[2] // block_rows) - 1).bit_length(), []).append(item)
        for size, items in classes.items():
            parts = 1 << size
            if parts < 2:
                continue
            schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in order[:level]], T.StructField("_item", T.LongType())])
            table = spark.createDataFrame([(*group, *prefix, i) for i, (group, prefix, _) in enumerate(items)], schema)
            match = [*keys, *order[:level]]
            here = rows.join(F.broadcast(table), match) if match else rows.withColumn("_item", F.lit(0))
            grid = [i / parts for i in range(1, parts)]
            found = here.groupBy("_item").agg(F.percentile_approx(column, grid, max(1_000, 10 * parts)).alias("at")).collect()
            for r in found:
                group, prefix, n = items[r["_item"]]
                rest = (FIRST,) * (len(order) - level - 1)
                for value in set(r["at"]):
                    borders[group].add((*prefix, value, *rest))
                    times = r["at"].count(value)
                    if times > 1:
                        borders[group].add((*prefix, value + 1, *rest))
                        hot.append((group, (*prefix, value), times * n // parts))
        open_items = hot
    return [(group, sorted(at)) for group, at in borders.items()]


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], sizes: tuple[int, int] | None = None) -> Blocked:
    """Cut each group into blocks along the order of several integer columns.

    The borders of large groups are found once by small jobs and are constants
    from then on, so a row's block is an expression of the row, the same for
    totals and rows, and nothing is written. ``sizes`` are those of ``group_sizes`` if they are known;
    they may be too large.
    """
    largest, whole = sizes or group_sizes(df, by)
    solid, keys = solid_keys(df, by)
    rows = solid.withColumns({f"_k{i}": F.coalesce(F.col(c).cast("bigint"), F.lit(FIRST).cast("bigint")) for i, c in enumerate(order)})
    places = [f"_k{i}" for i in range(len(order))]
    block_rows = _block_rows(by, whole)
    listed = order_borders(rows, keys, places, block_rows) if largest > block_rows else []
    if not listed:
        return Blocked(rows.withColumn(BLOCK, F.lit(0).cast("bigint")), keys, places, False)
    place = T.StructType([T.StructField(c, T.LongType()) for c in places])
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_borders", T.ArrayType(place))])
    table = df.sparkSession.createDataFrame([(*group, at) for group, at in listed], schema)
    joined = rows.join(F.broadcast(table), keys, "left") if keys else attach(rows, table, "_b").withColumn("_borders", F.col("_b._borders")).drop("_b")
    here, longest = F.struct(*places), max(len(at) for _, at in listed)
    # Binary search for the number of borders up to the row.
    steps = F.lit([1 << i for i in range(longest.bit_length() - 1, -1, -1)])

    def further(found: Column, step: Column) -> Column:
        holds = (found + step <= F.size("_borders")) & (F.get("_borders", found + step - 1) <= here)
        return F.when(holds, found + step).otherwise(found)

    block = F.aggregate(steps, F.lit(0), further).cast("bigint")
    return Blocked(joined.withColumn(BLOCK, block).drop("_borders"), keys, places, True)


def scan_blocked(blocked: Blocked, scans: Sequence[Scan], keep: Sequence[str]) -> DataFrame:
    """Running columns along the order; a frame without cuts needs one window, one with cuts a scan of block totals too."""
    if blocked.cut:
        dealt = blocked.rows.repartition(*blocked.keys, BLOCK)
        return _scan_blocks(dealt, blocked.keys, blocked.order, scans, (), keep)
    window = blocked.window()
    running = [_running(s, s.column, window, s.before) for s in scans]
    # A running sum over no rows yet is 0, as it is where blocks inherit.
    whole = [F.coalesce(c, F.lit(0)) if s.op == "sum" else c for s, c in zip(scans, running)]
    return blocked.rows.select(*keep, *[c.alias(s.name) for s, c in zip(scans, whole)])


def nested_sum(df: DataFrame, order: Sequence[str], column: str, by: Sequence[str] = (), name: str = "sum",
               sizes: tuple[int, int] | None = None) -> DataFrame:
    """Running sum of ``column`` per group in the order of several integer columns, unique together."""
    return scan_blocked(in_blocks(df, by, order, sizes), [Scan(name, "sum", column)], df.columns)


def with_ordinal(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Number rows 1..n per group in the order of integer columns that are unique together."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return nested_sum(counted, order, "_one", by, name).drop("_one")


def text_ordinal(df: DataFrame, column: str, name: str = "ordinal") -> DataFrame:
    """Number the rows of distinct texts 1..n."""
    ranged = df.repartitionByRange(F.col(column))
    cut = materialise(ranged.withColumn(BLOCK, F.spark_partition_id().cast("bigint")))
    counted = cut.withColumn("_one", F.lit(1).cast("bigint"))
    return _scan_blocks(counted, [], [column], [Scan(name, "sum", "_one")], (), [*df.columns])
