"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The smallest double with a full mantissa.
SMALLEST_NORMAL = 2.0 ** -1022

# Microseconds per unit of an epoch timestamp.
MICROS_PER_UNIT = {"s": 1_000_000, "ms": 1_000, "us": 1}


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp (the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def numeric_epoch_micros(value: Column, unit: str) -> Column:
    """Microseconds since the epoch of a number counted in ``unit``; nanoseconds are divided exactly."""
    if unit == "ns":
        return F.floor(value.cast("decimal(20,0)") / F.lit(1000)).cast("bigint")
    if unit not in MICROS_PER_UNIT:
        raise ValueError(f"Unknown time unit: {unit!r}")
    return F.round(value * F.lit(MICROS_PER_UNIT[unit])).cast("bigint")


def to_seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)


def log10p1(x: Column) -> Column:
    return F.log10(x + F.lit(1.0))


def exact_total(x: Column) -> Column:
    """Sum of integers that neither overflows nor depends on the order of addition."""
    return F.sum(x.cast("decimal(20,0)"))


def exact_mean(x: Column) -> Column:
    """Mean of integers, exact up to one final division; null for no rows."""
    return F.try_divide(exact_total(x).cast("double"), F.count(x).cast("double"))


def double_key(x: Column) -> Column:
    """BIGINT in the order of the doubles, different for different ones: exponent, then mantissa.

    NaN comes last. The binary exponent is a logarithm corrected where rounding
    put it off by one.
    """
    size = F.abs(x)
    normal = F.greatest(size, F.lit(SMALLEST_NORMAL))
    guess = F.floor(F.log2(normal))
    guess = F.least(F.greatest(guess, F.lit(-1022)), F.lit(1023)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(normal < power, guess - 1).when(normal / power >= 2.0, guess + 1).otherwise(guess)
    mantissa = normal / F.pow(F.lit(2.0), exponent) - F.lit(1.0)
    high = F.shiftleft((exponent + F.lit(1023.0)).cast("bigint"), 52)
    # Below the normal range numbers are even steps of the smallest one.
    steps = size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)
    positive = F.when(F.isnan(x), F.lit(2047 << 52).cast("bigint") + F.lit(1)) \
        .when(size == F.lit(float("inf")), F.lit(2047 << 52).cast("bigint")) \
        .when(size < F.lit(SMALLEST_NORMAL), steps.cast("bigint")) \
        .otherwise(high + (mantissa * F.lit(float(1 << 52))).cast("bigint"))
    return F.when(x < 0, -positive).otherwise(positive)


def order_key(x: Column, dtype: str) -> Column:
    """BIGINT that never decreases as ``x`` grows; different integers and doubles have different keys."""
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        return x.cast("bigint")
    return double_key(x.cast("double"))
