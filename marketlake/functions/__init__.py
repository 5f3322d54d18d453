"""Column expressions shared by the operators (built-in functions only)."""

from marketlake.functions.dates import business_days, period_start, quarter_label
from marketlake.functions.stats import (
    excess_kurtosis,
    normal_density,
    ratio,
    sample_skewness,
    without_nan,
)
from marketlake.functions.text import (
    decimal_comma,
    instrument_id,
    instrument_ticker,
    normal_ticker,
    spanish_number,
)

__all__ = [
    "business_days",
    "decimal_comma",
    "excess_kurtosis",
    "instrument_id",
    "instrument_ticker",
    "normal_density",
    "normal_ticker",
    "period_start",
    "quarter_label",
    "ratio",
    "sample_skewness",
    "spanish_number",
    "without_nan",
]
