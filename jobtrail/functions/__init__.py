from jobtrail.functions.expressions import (
    epoch_micros, exact_mean, exact_total, log10p1, order_key, to_seconds,
)
from jobtrail.functions.frames import attach, null_safe_join, require_columns, salted_join, single_row

__all__ = [
    "attach", "epoch_micros", "exact_mean", "exact_total", "log10p1", "null_safe_join",
    "order_key", "require_columns", "salted_join", "single_row", "to_seconds",
]
