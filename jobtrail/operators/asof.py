"""As-of joins in any direction: the right row before, after or nearest to each left row's instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from jobtrail.functions.frames import null_safe_join, unused
from jobtrail.operators.scan import BLOCK, in_blocks

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (),
              direction: str = "backward", tolerance: int | None = None, tie: str | None = None,
              at: str | None = None) -> DataFrame:
    """Add ``values`` of the right row whose BIGINT instant ``on`` is at or before, at or after, or nearest to the left one.

    An equal instant always counts. Nearest takes the earlier of two rows equally far. Beyond ``tolerance`` there is no
    match. Right rows of one instant are ordered by ``tie``: looking back the last of them counts, looking
    forward the first. ``at`` names a column for the instant found. Left rows without an instant or a match
    have nulls; right rows without an instant never match; null groups match each other.

    Right rows are reduced to one per instant, left rows to their distinct
    instants, and both lie on one timeline per group, which is shuffled once and sorted for each way
    it is scanned: ahead is back in the reverse order, since a frame that ends with the group is gone
    through anew for every row. A group of any size is cut
    into blocks, which learn the last row before and the first row after them.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"Unknown direction: {direction!r}")
    tie = tie or on
    row = unused("_asof", left, right)
    seen = F.struct(*[F.col(v).alias(v) for v in values])
    points = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(
        F.struct(F.min_by(seen, tie).alias("first"), F.max_by(seen, tie).alias("last")).alias(row))
    points = points.withColumn(row, F.struct(F.col(on).alias("at"), f"{row}.first", f"{row}.last"))
    asked = f"{row}_asked"
    slots = left.where(F.col(on).isNotNull()).select(*by, on).distinct()
    timeline = points.select(*by, on, F.lit(0).alias(asked), row).unionByName(
        slots.select(*by, on, F.lit(1).alias(asked), F.lit(None).cast(points.schema[row].dataType).alias(row)))
    # At one instant the point comes first, so looking back finds an equal one.
    blocked = in_blocks(timeline, by, [on, asked])
    block, window = [*blocked.keys, BLOCK], blocked.window()
    reverse = Window.partitionBy(*block).orderBy(*[F.desc(c) for c in blocked.order])
    rows = blocked.rows.repartition(*block) if blocked.cut else blocked.rows
    ways = rows.withColumns({
        f"{row}_back": F.last(row, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)),
        f"{row}_ahead": F.last(row, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0))})
    back, ahead = F.col(f"{row}_back"), F.col(f"{row}_ahead")
    if blocked.cut:
        place = F.when(F.col(row).isNotNull(), F.struct(*blocked.order))
        ends = rows.groupBy(*block).agg(F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last"))
        over, back_over = (Window.partitionBy(*blocked.keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                           for o in (F.asc(BLOCK), F.desc(BLOCK)))
        handed = ends.select(
            *block, F.last("_last", ignorenulls=True).over(over).alias(f"{row}_before"),
            F.last("_first", ignorenulls=True).over(back_over).alias(f"{row}_after"))
        ways = ways.join(handed.hint("shuffle_hash"), block)
        back, ahead = F.coalesce(back, f"{row}_before"), F.coalesce(ahead, f"{row}_after")
    here = F.col(on)
    before = F.when(back.isNotNull(), F.struct(back["at"].alias("at"), back["last"].alias("row")))
    equal = back["at"] == here
    after = F.when(equal, F.struct(back["at"].alias("at"), back["first"].alias("row"))) \
        .when(ahead.isNotNull(), F.struct(ahead["at"].alias("at"), ahead["first"].alias("row")))
    # Found while looking back, an equal instant is at distance 0 and wins.
    nearer = F.when(after["at"].isNull() | (here - before["at"] <= after["at"] - here), before).otherwise(after)
    found = {"backward": before, "forward": after, "nearest": nearer}[direction]
    chosen = ways.where(F.col(asked) == 1).select(*by, on, found.alias(row))
    if tolerance is not None:
        chosen = chosen.where(F.abs(F.col(row)["at"] - here) <= tolerance)
    out = [F.col(row)["row"][v].alias(v) for v in values]
    if at:
        out.append(F.col(row)["at"].alias(at))
    return null_safe_join(left, chosen.select(*by, on, *out), [*by, on], "left")
