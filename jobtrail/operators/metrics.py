"""Quality of runtime predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.functions.frames import attach
from jobtrail.operators.quantiles import quantiles
from jobtrail.operators.stats import ecdf, histogram


def _errors(df: DataFrame, actual: str, predicted: str, by: Sequence[str]) -> DataFrame:
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return pairs.select(*by, y.alias("_y"), p.alias("_p"), F.abs(y - p).alias("_abs"))


def error_aggregates() -> list[Column]:
    """Metrics of the pairs ``_y``, ``_p`` with absolute error ``_abs``; rows where these are null do not count."""
    y, p, err = F.col("_y"), F.col("_p"), F.col("_abs")
    n = F.count("_abs").cast("double")
    sse, sst = F.sum(err * err), F.var_pop(y) * n
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        F.count("_abs").alias("n"),
        F.avg(err).alias("mae"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.when(sst == 0, flat).otherwise(F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
        F.coalesce(F.avg(F.when(y > 0, F.try_divide(err, y))), F.lit(float("nan"))).alias("mape"),
        F.avg(F.when(F.abs(y) + F.abs(p) > 0, F.lit(2.0) * F.try_divide(err, F.abs(y) + F.abs(p)))
              .otherwise(F.lit(0.0))).alias("smape"),
        F.avg(p - y).alias("bias"),
        F.avg((p > y).cast("double")).alias("over_share"),
        F.avg((p < y).cast("double")).alias("under_share"),
    ]


ERROR_NAMES = ("n", "mae", "rmse", "r2", "mape", "smape", "bias", "over_share", "under_share")
CORE = ["mae", "rmse", "r2", "mape", "mdae"]


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, MAPE (positive targets only; NaN if none) and median absolute error."""
    return error_report(df, actual, predicted, by).select(*by, *CORE)


def error_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The core metrics with row count, SMAPE, bias and the over- and underpredicted shares."""
    errors = _errors(df, actual, predicted, by)
    marks = quantiles(errors, "_abs", {"mdae": 0.5}, by)
    if not by:
        return attach(errors.agg(*error_aggregates()), marks, "_q").select("*", "_q.mdae").drop("_q")
    return errors.groupBy(*by).agg(*error_aggregates()).join(marks, list(by), "left")


def error_by_runtime_bin(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Errors per decade of the actual runtime."""
    decade = F.floor(F.log10(F.col(actual))).cast("bigint")
    return error_report(df.where(F.col(actual) > 0).withColumn("decade", decade), actual, predicted, ["decade"])


def with_residual(df: DataFrame, actual: str, predicted: str, sign: str = "pred-actual") -> DataFrame:
    if sign not in ("pred-actual", "actual-pred"):
        raise ValueError(f"Unknown residual sign: {sign!r}")
    difference = F.col(predicted) - F.col(actual)
    return df.withColumn("residual", difference if sign == "pred-actual" else -difference)


def residual_histogram(df: DataFrame, actual: str, predicted: str, bins: int = 50,
                       sign: str = "pred-actual") -> DataFrame:
    """Histogram of the residuals with their mean on every row."""
    rows = with_residual(df, actual, predicted, sign)
    mean = rows.agg(F.avg("residual").alias("mean"))
    return attach(histogram(rows, "residual", bins), mean, "_m").select("*", F.col("_m.mean").alias("mean_residual")) \
        .drop("_m")


def error_ecdf(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions within each absolute error."""
    return ecdf(df.withColumn("_abs", F.abs(F.col(actual) - F.col(predicted))), "_abs", by)


def clip_predictions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative predicted runtimes become zero."""
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in columns})


def predictions_long(df: DataFrame, columns: Mapping[str, str], keep: Sequence[str] = ("job_id",)) -> DataFrame:
    """One row per job and policy from one predicted-runtime column per policy (name -> column)."""
    entries = F.array(*[F.struct(F.lit(name).alias("policy"), F.col(c).alias("predicted_runtime"))
                        for name, c in columns.items()])
    return df.select(*keep, F.inline(entries))


def leaderboard(metrics: DataFrame, key: str, ascending: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rank rows of a metrics table (one row per model or policy) by one metric."""
    from pyspark.sql import Window

    # A metrics table has a row per model, so one window over it is small.
    order = F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)).cast("bigint"))
