"""Feature columns, scaling and category encoding."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.functions.frames import attach, require_columns, salted_join, single_row
from jobtrail.operators.scan import text_ordinal
from jobtrail.operators.splits import chrono_split
from jobtrail.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET

FEATURE_MODES = ("numeric_only", "with_categorical_native", "with_categorical_onehot", "with_categorical",
                 "with_categorical_ordered")
# Weight of the overall mean in a category's code, in rows.
SMOOTHING = 20.0


def feature_columns(jobs: DataFrame) -> tuple[list[str], list[str]]:
    """Default numeric and categorical inputs that exist in the table."""
    return ([c for c in NUMERIC_FEATURES if c in jobs.columns],
            [c for c in CATEGORICAL_FEATURES if c in jobs.columns])


def feature_matrix(jobs: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = TARGET,
                   test_size: float = 0.2) -> DataFrame:
    """Inputs and ``label`` of each job with its chronological ``split``."""
    for name in [*numeric, *categorical, target]:
        if name not in jobs.columns:
            raise ValueError(f"The job table has no {name!r}.")
    split = chrono_split(jobs, test_size)
    return split.select("job_id", *numeric, *categorical, F.col(target).alias("label"), "split")


def minmax_ranges(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest value and width of each column in one row; a constant column has width 1."""
    ends = train.agg(*[f for c in columns for f in (F.min(c).cast("double").alias(f"{c}_lo"),
                                                    F.max(c).cast("double").alias(f"{c}_hi"))])
    return ends.select(*[f for c in columns for f in (
        F.col(f"{c}_lo"),
        F.when(F.col(f"{c}_hi") == F.col(f"{c}_lo"), F.lit(1.0))
        .otherwise(F.col(f"{c}_hi") - F.col(f"{c}_lo")).alias(f"{c}_width"))])


def minmax_scale(df: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale by ranges learnt on the train part; other rows may fall outside 0..1."""
    scaled = {c: (F.col(c).cast("double") - F.col(f"_s.{c}_lo")) / F.col(f"_s.{c}_width") for c in columns}
    return attach(df, ranges, "_s").withColumns(scaled).drop("_s")


def minmax_restore(df: DataFrame, ranges: DataFrame, column: str, source: str) -> DataFrame:
    """Bring a scaled column back to the units of ``source``."""
    restored = F.col(column) * F.col(f"_s.{source}_width") + F.col(f"_s.{source}_lo")
    return attach(df, ranges, "_s").withColumn(column, restored).drop("_s")


def category_index(train: DataFrame, column: str) -> DataFrame:
    """Categories of the train part numbered from 0 in alphabetical order."""
    values = train.select(F.col(column).alias("category")).where(F.col("category").isNotNull()).distinct()
    return text_ordinal(values, "category", "index").withColumn("index", F.col("index") - 1)


def onehot_long(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The non-zero one-hot entries of each job; categories unseen in train have none."""
    out = None
    for column in columns:
        known = train.select(column).where(F.col(column).isNotNull()).distinct()
        part = df.select("job_id", column).join(known, column, "left_semi").select("job_id", F.concat(F.lit(f"{column}_"), F.col(column)).alias("feature"),
                          F.lit(1.0).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def category_names(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, name``: what the one-hot entries ``<column>_<index>`` stand for."""
    out = None
    for column in columns:
        known = category_index(train, column).select(
            F.concat(F.lit(f"{column}_"), F.col("index").cast("string")).alias("feature"),
            F.concat(F.lit(f"{column}_"), F.col("category")).alias("name"))
        out = known if out is None else out.unionByName(known)
    return out


def with_category_indexes(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Add ``<column>_index`` marked as categorical; unseen categories share one last index.

    Only the number of categories comes to the driver, for the column's
    metadata; ``category_names`` has the names.
    """
    sizes = {}
    for column in columns:
        known = category_index(train, column)
        size = known.count()
        nominal = {"type": "nominal", "num_vals": size + 1}
        table = known.select(F.col("category").alias(column), F.col("index").alias("_index"))
        joined = df.join(table, column, "left")
        marked = F.coalesce(F.col("_index"), F.lit(size)).cast("double").alias(
            f"{column}_index", metadata={"ml_attr": nominal})
        df = joined.select(*df.columns, marked)
        sizes[column] = size
    return df, sizes


def target_codes(df: DataFrame, columns: Sequence[str], target: str = "label", train: Column | None = None,
                 smoothing: float = SMOOTHING, spread: str = "job_id") -> DataFrame:
    """Add ``<column>_code``: one number per category, ordered by the target, learnt from the train rows.

    The code is the mean target of the category's train rows, drawn towards the
    overall mean as if ``smoothing`` rows more had it. A train row does not count
    itself (leave-one-out), so a rare category does not give its target away.
    Categories without train rows have the overall mean; null is a category. Learners see a plain number: the bins of
    their histograms need not grow with the categories. Targets are summed as
    decimals of six places, in any order. Sums are combined before the shuffle and
    a category of many rows is split when it meets them.
    """
    train = F.col("split") == "train" if train is None else train
    own = F.when(F.coalesce(train, F.lit(False)), F.col(target).cast("decimal(28,6)"))
    mean = single_row(df.agg((F.sum(own).cast("double") / F.count(own)).alias("mean")))["mean"]
    out = df
    for column in columns:
        name = next(n for n in (f"_known{i}" for i in itertools.count()) if n not in out.columns)
        sums = df.groupBy(F.col(column).alias(column)).agg(F.struct(F.sum(own).alias("sum"), F.count(own).alias("rows")).alias(name))
        joined = salted_join(out, sums, [column], [spread], how="left")
        others = F.coalesce(F.col(name)["sum"], F.lit(0)) - F.coalesce(own, F.lit(0).cast("decimal(28,6)"))
        rows = F.coalesce(F.col(name)["rows"], F.lit(0)) - own.isNotNull().cast("int")
        code = (others.cast("double") + F.lit(smoothing) * mean) / (rows + F.lit(smoothing))
        out = joined.select(*out.columns, code.alias(f"{column}_code"))
    return out


def assemble(df: DataFrame, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
             mode: str = "numeric_only") -> tuple[DataFrame, int]:
    """Add the ``features`` vector of one mode; also returns the largest category count.

    The native modes keep category indexes, which tree learners split on as
    sets; one-hot vectors stay sparse and are all zero for unseen categories; the
    ordered mode has one number per category (``target_codes``; needs ``label`` and ``split``).
    """
    if mode not in FEATURE_MODES:
        raise ValueError(f"Unknown feature_mode: {mode!r}")
    require_columns(df, numeric)
    if mode == "numeric_only" or not categorical:
        return VectorAssembler(inputCols=list(numeric), outputCol="features").transform(df), 0
    if mode == "with_categorical_ordered":
        coded = target_codes(df, categorical)
        inputs = [*numeric, *[f"{c}_code" for c in categorical]]
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(coded), 0
    indexed, sizes = with_category_indexes(df, train, categorical)
    inputs = [f"{c}_index" for c in categorical]
    if mode == "with_categorical_onehot":
        vectors = [f"{c}_vector" for c in categorical]
        encoder = OneHotEncoder(inputCols=inputs, outputCols=vectors, dropLast=True)
        indexed, inputs = encoder.fit(indexed).transform(indexed), vectors
    assembled = VectorAssembler(inputCols=[*numeric, *inputs], outputCol="features").transform(indexed)
    return assembled, max(sizes.values()) + 1
