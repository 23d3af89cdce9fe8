"""Exact confidence limits of a Poisson count."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 90

LIMITS = T.StructType(
    [T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]
)

# The function travels with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _mean_with_cdf(count: int, probability: float) -> float:
    """The Poisson mean under which at most ``count`` events have ``probability``.

    Newton's method inside a shrinking bracket. Terms further than twelve
    deviations below the count are smaller than any double can resolve next to
    the rest, and are left out of the sum.
    """
    width = 12 * math.sqrt(count + 1) + 50
    k = np.arange(max(0, math.floor(count - width)), count + 1, dtype=float)
    logs = np.log(np.maximum(k, 1.0))
    logs[0] = 0.0
    log_factorial = math.lgamma(k[0] + 1) + np.cumsum(logs)
    low, high = max(0.0, count - width), count + width
    mean = float(count + 1)
    for _ in range(STEPS):
        terms = np.exp(k * math.log(mean) - mean - log_factorial)
        excess = terms.sum() - probability
        low, high = (mean, high) if excess > 0 else (low, mean)
        # The sum falls with the mean by the probability of the last term.
        step = excess / terms[-1] if terms[-1] > 0 else math.inf
        moved = mean + step if low < mean + step < high else (low + high) / 2
        if abs(moved - mean) <= 1e-15 * mean:
            break
        mean = moved
    return float(mean)


def poisson_limits(count: int, level: float = 0.95) -> tuple[float, float]:
    """Exact two-sided limits of the mean behind an observed ``count``."""
    tail = (1 - level) / 2
    lower = 0.0 if count == 0 else _mean_with_cdf(count - 1, 1 - tail)
    return lower, _mean_with_cdf(count, tail)


@F.pandas_udf(LIMITS)
def _limits(counts: pd.Series) -> pd.DataFrame:
    known = {int(c): poisson_limits(int(c)) for c in counts.dropna().unique()}
    missing = (math.nan, math.nan)
    pairs = [missing if pd.isna(c) else known[int(c)] for c in counts]
    return pd.DataFrame(pairs, columns=["lower", "upper"])


def limits_of_count(count: Column) -> Column:
    """Struct ``lower, upper`` of a count; meant for aggregated rows."""
    return _limits(count)
