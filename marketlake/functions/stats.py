from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio(value: Column, base: Column) -> Column:
    """value / base, null where the base is zero or missing."""
    return value / F.nullif(base, F.lit(0.0))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; null below three values, zero without spread."""
    n = F.count(value).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    flat = F.var_pop(value) == 0
    return F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(F.skewness(value) * factor))


def excess_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, zero without spread."""
    n = F.count(value).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    flat = F.var_pop(value) == 0
    full = scale * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n >= 4, F.when(flat, F.lit(0.0)).otherwise(full))


def normal_density(x: Column, mean: Column, std: Column) -> Column:
    spread = F.nullif(std, F.lit(0.0))
    z = (x - mean) / spread
    return F.exp(-z * z / 2) / (spread * math.sqrt(2 * math.pi))
