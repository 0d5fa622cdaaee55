"""Small DataFrame helpers: scalar rows, null-safe joins, salting, column checks."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Ways a hot key is split when it meets its one row of statistics.
SALTS = 64


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Check names at plan time; no job runs."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Required column {name!r} is absent; there are {df.columns}.")


def single_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct("*").alias("row")).scalar()


def attach(df: DataFrame, row: DataFrame, name: str = "_row") -> DataFrame:
    """Add the only row of ``row`` to every row of ``df`` as a struct column.

    The one row is computed once and becomes a constant, so neither a join nor
    a shuffle of ``df`` is planned.
    """
    return df.withColumn(name, single_row(row))


def unused(stem: str, *frames: DataFrame) -> str:
    """``stem`` with a number, so that no column of the frames begins like it."""
    names = [c for df in frames for c in df.columns]
    return next(s for s in (f"{stem}{i}" for i in itertools.count()) if not any(n.startswith(s) for n in names))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; key columns come from the left."""
    nullable = {f.name for f in left.schema.fields if f.nullable}
    if not nullable.intersection(on):
        return left.join(right, list(on), how).select(*left.columns, *[c for c in right.columns if c not in on])
    keys = [f"{unused('_r', left, right)}_{c}" for c in on]
    renamed = right.select(*[F.col(c).alias(key) for c, key in zip(on, keys)], *[c for c in right.columns if c not in on])
    condition = F.lit(True)
    for c, key in zip(on, keys):
        condition = condition & F.col(c).eqNullSafe(F.col(key))
    return left.join(renamed, condition, how).drop(*keys)


def salted_join(rows: DataFrame, stats: DataFrame, by: Sequence[str], spread: Sequence[str],
                salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join many rows per key with the one row of statistics of that key.

    Each key is cut into ``salts`` parts by the hash of the ``spread`` columns
    and its statistics row is repeated once per part, so a key holding a large
    share of the rows is still shared among tasks.
    """
    if not by:
        return attach(rows, stats, "_stats").select(*rows.columns, "_stats.*")
    salt = unused("_salt", rows, stats)
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = stats.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(left, right, [*by, salt], how).drop(salt)
