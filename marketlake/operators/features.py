"""Model inputs: technical and calendar features, and the split by time."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlake.functions import ratio
from marketlake.operators.candles import moving_average
from marketlake.operators.index import as_of_dates
from marketlake.operators.returns import by_date
from marketlake.plans.joins import join_by_date

# Shares of the distinct dates.
TRAIN, VALIDATION, TEST = 0.70, 0.15, 0.15


def check_shares(train: float, validation: float, test: float) -> None:
    for share in (train, validation, test):
        if not 0 < share < 1:
            raise ValueError(f"share {share} is not between 0 and 1")
    if abs(train + validation + test - 1.0) > 1e-3:
        raise ValueError(f"shares add up to {train + validation + test:.4f}, not 1")


def split_by_time(
    df: DataFrame, train: float = TRAIN, validation: float = VALIDATION, test: float = TEST
) -> DataFrame:
    """Every row marked train, validation or test by the position of its date.

    The distinct dates are ranked, not the rows, and joined back.
    """
    check_shares(train, validation, test)
    dates = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    rank = F.row_number().over(W.orderBy("date"))
    total = F.count(F.lit(1)).over(W.partitionBy())
    part = (
        F.when(F.col("_rank") <= F.floor(F.col("_total") * train), "train")
        .when(F.col("_rank") <= F.floor(F.col("_total") * (train + validation)), "validation")
        .otherwise("test")
    )
    marked = dates.withColumns({"_rank": rank, "_total": total}).select("date", part.alias("part"))
    return join_by_date(df, marked)


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of the last n closes, plus and minus `width` population standard deviations."""
    middle = moving_average("close", n)
    spread = F.stddev_pop("close").over(by_date().rowsBetween(-(n - 1), 0)) * width
    return bars.withColumns(
        {"bb_middle": middle, "bb_upper": middle + spread, "bb_lower": middle - spread}
    )


def true_range(bars: DataFrame) -> DataFrame:
    """Largest of high-low and the distances of both to the previous close."""
    prev = F.lag("close").over(by_date())
    reach = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return bars.withColumn("true_range", reach)


def average_true_range(bars: DataFrame, n: int = 14) -> DataFrame:
    return true_range(bars).withColumn("atr", moving_average("true_range", n))


def relative_strength(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI over the last n changes with simple means; null until n changes exist."""
    change = F.col("close") - F.lag("close").over(by_date())
    frame = by_date().rowsBetween(-(n - 1), 0)
    moves = bars.withColumns(
        {"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))}
    )
    # greatest() skips nulls, so the first row counts as no move and is kept out by position.
    up, down = F.sum("_up").over(frame), F.sum("_down").over(frame)
    return moves.withColumn(
        "rsi", F.when(F.row_number().over(by_date()) > n, ratio(up * 100, up + down))
    ).drop("_up", "_down")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal line and histogram from recursive moving averages.

    The recursion needs the whole series of a ticker in order, which one row per calendar day
    bounds; only three columns go through Arrow.
    """

    def lines(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("date")
        close = series["close"]
        line = (
            close.ewm(span=fast, adjust=False).mean() - close.ewm(span=slow, adjust=False).mean()
        )
        average = line.ewm(span=signal, adjust=False).mean()
        return series[["ticker", "date"]].assign(
            macd=line, macd_signal=average, macd_hist=line - average
        )

    return (
        bars.select("ticker", "date", "close")
        .groupBy("ticker")
        .applyInPandas(
            lines,
            "ticker string, date date, macd double, macd_signal double, macd_hist double",
        )
    )


def calendar_features(bars: DataFrame, settlements: DataFrame | None = None) -> DataFrame:
    """Day of week (Monday 0) and, given settlement dates, days since the last and to the next."""
    featured = bars.withColumn("day_of_week", F.weekday("date"))
    if settlements is None:
        return featured
    days = bars.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    last = as_of_dates(days, settlements).withColumnRenamed("resolved", "_last")
    following = _next_dates(days, settlements)
    near = last.join(following, "date").select(
        "date",
        F.date_diff("date", "_last").alias("days_since_settlement"),
        F.date_diff("_next", "date").alias("days_to_settlement"),
    )
    return join_by_date(featured, near)


def _next_dates(days: DataFrame, available: DataFrame) -> DataFrame:
    """(date, _next): the first available date not before each day, over distinct days only."""
    rows = days.select("date", F.lit(True).alias("_wanted"), F.lit(None).cast("date").alias("_has"))
    marks = available.select("date", F.lit(False).alias("_wanted"), F.col("date").alias("_has"))
    merged = (
        rows.unionByName(marks)
        .groupBy("date")
        .agg(F.bool_or("_wanted").alias("_wanted"), F.max("_has").alias("_has"))
    )
    ahead = W.orderBy("date").rowsBetween(0, W.unboundedFollowing)
    return merged.select("date", "_wanted", F.min("_has").over(ahead).alias("_next")).filter(
        "_wanted"
    ).drop("_wanted")


def technical_features(bars: DataFrame) -> DataFrame:
    """All window-based features side by side; they share one shuffle and one sort."""
    steps = [bollinger, average_true_range, relative_strength]
    return reduce(lambda df, step: step(df), steps, bars)
