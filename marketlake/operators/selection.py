"""Ranges, filters and small projections."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlake.functions import instrument_id, instrument_ticker, period_start, without_nan
from marketlake.schemas import OHLCV_COLUMNS


def date_range(
    df: DataFrame, date_from: datetime.date | None = None, date_to: datetime.date | None = None
) -> DataFrame:
    """Rows with date_from <= date <= date_to; an open end is None."""
    if date_from is not None:
        df = df.filter(F.col("date") >= F.lit(date_from))
    if date_to is not None:
        df = df.filter(F.col("date") <= F.lit(date_to))
    return df


def trailing_range(
    df: DataFrame, label: str, as_of: datetime.date, max_start: datetime.date | None = None
) -> DataFrame:
    """Rows of the last 3M, 6M, 1Y or 3Y before `as_of`, or all of them for MAX.

    With `max_start` set, MAX and any unknown label begin at that day instead.
    """
    try:
        start = period_start(as_of, label)
    except ValueError:
        if max_start is None:
            raise
        start = None
    if start is None:
        return df if max_start is None else df.filter(F.col("date") >= F.lit(max_start))
    return df.filter(F.col("date") >= start)


def for_ticker(df: DataFrame, ticker: str) -> DataFrame:
    return df.filter(F.col("ticker") == ticker.upper())


def with_history(df: DataFrame, min_rows: int) -> DataFrame:
    """Rows of tickers holding at least `min_rows` rows."""
    rows = F.count(F.lit(1)).over(W.partitionBy("ticker"))
    return df.withColumn("_rows", rows).filter(F.col("_rows") >= min_rows).drop("_rows")


def canonical_bars(records: DataFrame) -> DataFrame:
    """Response records (o, h, l, c, v, d plus ticker) under the stored column names."""
    return records.select(
        F.to_date(F.substring("d", 1, 10), "yyyy-MM-dd").alias("date"),
        F.col("o").cast("double").alias("open"),
        F.col("h").cast("double").alias("high"),
        F.col("l").cast("double").alias("low"),
        F.col("c").cast("double").alias("close"),
        F.col("v").cast("double").alias("volume"),
        "ticker",
    ).select(*OHLCV_COLUMNS)


def tagged(df: DataFrame, **tags: object) -> DataFrame:
    """Constant columns, such as source='vigente'."""
    return df.withColumns({name: F.lit(value) for name, value in tags.items()})


def rewritten(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """`column` replaced by `value` where the condition holds."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def usable_price(df: DataFrame, columns: tuple[str, ...] = ("open", "close")) -> Column:
    """True where ticker and date are known and every price is a number other than zero."""
    good = F.col("ticker").isNotNull() & F.col("date").isNotNull()
    for name in columns:
        good = good & F.coalesce(without_nan(F.col(name)) != 0, F.lit(False))
    return good


def rejected_prices(df: DataFrame, columns: tuple[str, ...] = ("open", "close")) -> DataFrame:
    """The rows `usable_price` refuses, with the reason."""
    keys = F.col("ticker").isNull() | F.col("date").isNull()
    absent = F.lit(False)
    for name in columns:
        absent = absent | without_nan(F.col(name)).isNull()
    reason = F.when(keys, "missing key").when(absent, "missing price").otherwise("zero price")
    return df.filter(~usable_price(df, columns)).withColumn("reason", reason)


def day_flags(df: DataFrame) -> DataFrame:
    """Whether the bar closed at or above its open."""
    return df.withColumn("up", F.col("close") >= F.col("open"))


def instrument_codes(df: DataFrame) -> DataFrame:
    """The instrument code of every ticker, and the ticker read back from it."""
    coded = df.withColumn("instrument", instrument_id(F.col("ticker")))
    return coded.withColumn("ticker_back", instrument_ticker(F.col("instrument")))
