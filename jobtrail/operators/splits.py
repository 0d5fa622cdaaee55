"""Train, validation and test splits of exact size, folds and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.operators.quantiles import values_at_ranks, weighted_values
from jobtrail.operators.scan import with_ordinal

TIME_ORDER = ("arrival_us", "job_id")
HASH_ORDER = ("_hash", "job_id")
# Stands for a null in an order: rows without a value come last.
LAST = 1 << 62


def _or_last(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST).cast("bigint"))


def cut_points(df: DataFrame, ranks: Mapping[str, Column], order: Sequence[str] = TIME_ORDER) -> dict:
    """Where the rows at 0-based ``ranks`` lie in the order (BIGINT column, unique BIGINT tie-break).

    ``ranks`` are expressions over the row count ``total``. The leading column
    is located first; then only rows holding a located value are ranked by the
    tie-break. The result, a (lead, tie) pair per name or None
    beyond the last row, is all that comes to the driver, so a split becomes a
    comparison with constants that later scans can push down.
    """
    keys = df.select(_or_last(order[0]).alias("value"), _or_last(order[1]).alias("_tie"))
    found = values_at_ranks(weighted_values(keys, "value"), ranks).select(
        *ranks, *[(rank - F.col(f"{name}_before")).alias(f"{name}_rest") for name, rank in ranks.items()]).first()
    inside = {name: found for name in ranks if found is not None and found[name] is not None}
    if not inside:
        return {name: None for name in ranks}
    tied = keys.where(F.col("value").isin(sorted({found[name] for name in inside}))) \
        .groupBy(F.col("value").alias("_at"), F.col("_tie").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("_key", F.col("value"))
    ties = values_at_ranks(tied, {n: F.lit(found[f"{n}_rest"]).cast("bigint") for n in inside}, by=["_at"]) \
        .agg(*[F.max(F.when(F.col("_at") == found[n], F.col(n))).alias(n) for n in inside]).first()
    return {name: (found[name], ties[name]) if name in inside else None for name in ranks}


def _precedes(order: Sequence[str], cut: tuple | None) -> Column:
    """True for rows before the cut; a cut beyond the last row has all rows before it."""
    if cut is None:
        return F.lit(True)
    lead, tie = F.col(order[0]), F.col(order[1])
    if LAST in cut:
        lead, tie = _or_last(order[0]), _or_last(order[1])
    # A null compares as unknown, which counts as not before.
    return F.coalesce((lead < cut[0]) | ((lead == cut[0]) & (tie < cut[1])), F.lit(False)) if LAST in cut else \
        (lead < cut[0]) | ((lead == cut[0]) & (tie < cut[1]))


def _test_rows(test_size: float) -> Column:
    return F.ceil(F.lit(test_size) * F.col("total").cast("double")).cast("bigint")


def chrono_split(jobs: DataFrame, test_size: float = 0.2, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Add ``split``: the last ``ceil(test_size * n)`` jobs in time are ``test``, the others ``train``."""
    cuts = cut_points(jobs, {"test": F.col("total") - _test_rows(test_size)}, order)
    return jobs.withColumn("split", F.when(_precedes(order, cuts["test"]), F.lit("train")).otherwise(F.lit("test")))


def chrono_val_split(jobs: DataFrame, test_size: float = 0.2, val_size: float = 0.2, seq_len: int = 10,
                     order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Split for windows of ``seq_len`` rows ending at each job.

    Of the windows inside the train part the last ``max(1, int(n * val_size))``
    are ``val``. Jobs too early to end a window are ``warmup``.
    """
    n_train = F.col("total") - _test_rows(test_size)
    n_windows = F.greatest(n_train - F.lit(seq_len - 1), F.lit(0))
    n_val = F.greatest(F.floor(n_windows.cast("double") * F.lit(val_size)).cast("bigint"), F.lit(1))
    cuts = cut_points(jobs, {"warm": F.lit(seq_len - 1).cast("bigint"), "val": n_train - n_val, "test": n_train},
                      order)
    label = (F.when(_precedes(order, cuts["warm"]), "warmup").when(_precedes(order, cuts["val"]), "train")
             .when(_precedes(order, cuts["test"]), "val").otherwise("test"))
    return jobs.withColumn("split", label)


def _hashed(jobs: DataFrame, seed: int) -> DataFrame:
    """Add ``_hash``: 40 bits of the MD5 of job id and seed, the same in any SQL engine; the job id breaks ties."""
    digest = F.md5(F.concat(F.col("job_id").cast("string"), F.lit(f"|{seed}")))
    return jobs.withColumn("_hash", F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint"))


def hash_split(jobs: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffled split: the ``ceil(test_size * n)`` jobs first in hash order are ``test``."""
    hashed = _hashed(jobs, seed)
    cuts = cut_points(hashed, {"train": _test_rows(test_size)}, HASH_ORDER)
    part = F.when(_precedes(HASH_ORDER, cuts["train"]), F.lit("test")).otherwise(F.lit("train"))
    return hashed.withColumn("split", part).drop("_hash")


def with_fold(jobs: DataFrame, folds: int = 3, seed: int = 42, name: str = "fold") -> DataFrame:
    """Cut the jobs in hash order into folds whose sizes differ by at most one."""
    hashed = _hashed(jobs, seed)
    ends = {f"end{i}": F.floor(F.col("total") * F.lit(i) / F.lit(folds)).cast("bigint") for i in range(1, folds)}
    cuts = cut_points(hashed, ends, HASH_ORDER) if ends else {}
    fold = F.lit(folds - 1)
    for i in range(folds - 1, 0, -1):
        fold = F.when(_precedes(HASH_ORDER, cuts[f"end{i}"]), F.lit(i - 1)).otherwise(fold)
    return hashed.withColumn(name, fold).drop("_hash")


def with_holdout(jobs: DataFrame, share: float, seed: int = 42, name: str = "is_val") -> DataFrame:
    """Mark the ``ceil(share * n)`` jobs first in hash order as validation rows."""
    hashed = _hashed(jobs, seed)
    cuts = cut_points(hashed, {"val": _test_rows(share)}, HASH_ORDER)
    return hashed.withColumn(name, _precedes(HASH_ORDER, cuts["val"])).drop("_hash")


def sample_jobs(jobs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` jobs without replacement: the first in hash order, wherever they lie."""
    hashed = _hashed(jobs, seed)
    cuts = cut_points(hashed, {"end": F.lit(n).cast("bigint")}, HASH_ORDER)
    return hashed.where(_precedes(HASH_ORDER, cuts["end"])).drop("_hash")


def first_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The ``n`` earliest jobs."""
    return jobs.orderBy(*TIME_ORDER).limit(n)


def job_ordinal(jobs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """0-based chronological position of each job."""
    narrow = jobs.select("job_id", "arrival_us", *[c for c in columns if c not in ("job_id", "arrival_us")])
    return with_ordinal(narrow, list(TIME_ORDER)).withColumn("ordinal", F.col("ordinal") - 1)


def rows_of_split(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs whose id occurs in ``ids``."""
    return jobs.join(ids.select("job_id"), "job_id", "left_semi")
