"""Moving averages and the candlestick frame."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators.returns import by_date
from marketlake.operators.selection import date_range, day_flags


def moving_average(column: str, n: int) -> Column:
    """Mean of the last n rows, null until there are n."""
    return F.when(
        F.row_number().over(by_date()) >= n, F.avg(column).over(by_date().rowsBetween(-(n - 1), 0))
    )


def moving_averages(bars: DataFrame, lengths: tuple[int, ...] = (20, 50)) -> DataFrame:
    return bars.withColumns({f"sma{n}": moving_average("close", n) for n in lengths})


def candlestick(
    bars: DataFrame,
    date_from: datetime.date | None = None,
    date_to: datetime.date | None = None,
) -> DataFrame:
    """Bars in range with SMA 20, SMA 50 and the up flag; averages start inside the range."""
    return day_flags(moving_averages(date_range(bars, date_from, date_to)))
