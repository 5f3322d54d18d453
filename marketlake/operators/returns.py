"""Returns, volatility and distribution figures per ticker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from marketlake.functions import excess_kurtosis, normal_density, ratio, sample_skewness

TRADING_DAYS = 252
HISTOGRAM_BINS = 50
CURVE_POINTS = 300


def by_date() -> WindowSpec:
    """The rows of one ticker in order of date."""
    return W.partitionBy("ticker").orderBy("date")


def previous_close() -> Column:
    return F.lag("close").over(by_date())


def daily_returns(bars: DataFrame, percent: bool = True) -> DataFrame:
    """Change of the close against the previous row; null for the first row of a ticker.

    Apply a date range beforehand: the first row in range has no previous row.
    """
    change = ratio(F.col("close"), previous_close()) - 1
    return bars.withColumn("ret", change * 100 if percent else change)


def return_pairs(bars: DataFrame) -> DataFrame:
    """Only rows with a usable previous close: (ticker, date, ret in percent)."""
    return daily_returns(bars).filter(F.col("ret").isNotNull()).select("ticker", "date", "ret")


def aligned_returns(bars: DataFrame, min_rows: int = 10) -> DataFrame:
    """Returns by ticker and date, of tickers with at least `min_rows` rows.

    The long form of the wide frame: a cell without a return is a row that is not there, so neither the
    number of tickers nor their different histories add to it. `wide_returns` gives chosen
    tickers as columns.
    """
    return _returns_with_history(bars.dropna(subset=["ticker", "date"]), min_rows)


def wide_returns(bars: DataFrame, tickers: list[str], min_rows: int = 10) -> DataFrame:
    """One column per chosen ticker, one row per date with at least one return."""
    chosen = bars.filter(F.col("ticker").isin(*tickers))
    return (
        _returns_with_history(chosen, min_rows)
        .groupBy("date")
        .pivot("ticker", tickers)
        .agg(F.first("ret"))
    )


def _returns_with_history(bars: DataFrame, min_rows: int) -> DataFrame:
    rows = F.count(F.lit(1)).over(W.partitionBy("ticker"))
    return (
        daily_returns(bars)
        .withColumn("_rows", rows)
        .filter((F.col("_rows") >= min_rows) & F.col("ret").isNotNull())
        .select("ticker", "date", "ret")
    )


def rolling_volatility(bars: DataFrame, window: int = 20) -> DataFrame:
    """Annualised standard deviation (percent) of the last `window` daily returns.

    Null until `window` returns could exist, and where fewer than two of them do.
    """
    frame = by_date().rowsBetween(-(window - 1), 0)
    filled = (F.row_number().over(by_date()) > window) & (F.count("ret").over(frame) >= 2)
    spread = F.stddev_samp("ret").over(frame) * math.sqrt(TRADING_DAYS) * 100
    return daily_returns(bars, percent=False).withColumn("volatility", F.when(filled, spread))


def mean_volatility(volatility: DataFrame) -> DataFrame:
    return volatility.groupBy("ticker").agg(
        F.coalesce(F.avg("volatility"), F.lit(0.0)).alias("mean_volatility")
    )


def cumulative_return(bars: DataFrame) -> DataFrame:
    """Compounded change since the first row, in percent.

    A missing or zero previous close leaves the product as it was.
    """
    so_far = by_date().rowsBetween(W.unboundedPreceding, 0)
    step = F.coalesce(ratio(F.col("close"), previous_close()), F.lit(1.0))
    return (
        bars.withColumn("_step", step)
        .withColumn("cumulative", (F.product("_step").over(so_far) - 1) * 100)
        .drop("_step")
    )


def rebased(bars: DataFrame, base: float = 100.0) -> DataFrame:
    """Close relative to the first row, which becomes `base`."""
    start = F.first("close").over(by_date().rowsBetween(W.unboundedPreceding, 0))
    return bars.withColumn(
        "rebased", F.col("close") / F.coalesce(F.nullif(start, F.lit(0.0)), F.lit(1.0)) * base
    )


def comparison(bars: DataFrame, mode: str) -> DataFrame:
    """Tickers on one scale: mode "base100" or "cumulative"."""
    if mode == "base100":
        return rebased(bars).select("ticker", "date", F.col("rebased").alias("value"))
    if mode == "cumulative":
        return cumulative_return(bars).select("ticker", "date", F.col("cumulative").alias("value"))
    raise ValueError(f"unknown mode {mode!r}, choose base100 or cumulative")


def return_moments(returns: DataFrame) -> DataFrame:
    """Count, mean, both standard deviations, skewness and excess kurtosis per ticker."""
    return returns.groupBy("ticker").agg(
        F.count("ret").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_pop("ret").alias("std_pop"),
        F.stddev_samp("ret").alias("std_samp"),
        sample_skewness(F.col("ret")).alias("skew"),
        excess_kurtosis(F.col("ret")).alias("kurtosis"),
    )


def tail_flags(moments: DataFrame) -> DataFrame:
    """Strong asymmetry (|skew| > 1) and heavy tails (excess kurtosis > 3)."""
    return moments.withColumns(
        {
            "skewed": F.coalesce(F.abs("skew") > 1, F.lit(False)),
            "heavy_tails": F.coalesce(F.col("kurtosis") > 3, F.lit(False)),
        }
    )


def distribution(returns: DataFrame) -> DataFrame:
    """Quartiles, sample standard deviation, minimum and maximum per ticker.

    Exact percentiles: a ticker holds at most one value per calendar day.
    """
    quartiles = F.percentile("ret", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        returns.groupBy("ticker")
        .agg(
            quartiles.alias("_q"),
            F.stddev_samp("ret").alias("std"),
            F.min("ret").alias("min"),
            F.max("ret").alias("max"),
        )
        .select(
            "ticker",
            F.get("_q", F.lit(0)).alias("q1"),
            F.get("_q", F.lit(1)).alias("median"),
            F.get("_q", F.lit(2)).alias("q3"),
            "std",
            "min",
            "max",
        )
    )


def histogram(returns: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per ticker with count and probability density.

    The last bin includes the maximum; a ticker without spread has one bin.
    """
    whole = W.partitionBy("ticker")
    placed = returns.withColumns(
        {
            "low": F.min("ret").over(whole),
            "width": (F.max("ret").over(whole) - F.min("ret").over(whole)) / bins,
            "total": F.count("ret").over(whole),
        }
    )
    position = F.coalesce(F.floor(ratio(F.col("ret") - F.col("low"), F.col("width"))), F.lit(0))
    binned = placed.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
    counted = binned.groupBy("ticker", "bin").agg(
        F.first("low").alias("low"),
        F.first("width").alias("width"),
        F.first("total").alias("total"),
        F.count(F.lit(1)).alias("n"),
    )
    return counted.select(
        "ticker",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        "n",
        ratio(F.col("n"), F.col("total") * F.col("width")).alias("density"),
    )


def normal_curve(returns: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """Density of the fitted normal distribution at equal steps between minimum and maximum."""
    fitted = returns.groupBy("ticker").agg(
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("std"),
        F.min("ret").alias("low"),
        F.max("ret").alias("high"),
    )
    step = (F.col("high") - F.col("low")) / (points - 1)
    steps = fitted.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return steps.withColumn("x", F.col("low") + F.col("point") * step).select(
        "ticker", "point", "x", normal_density(F.col("x"), F.col("mean"), F.col("std")).alias("density")
    )


def sign_flags(returns: DataFrame) -> DataFrame:
    return returns.withColumn("gain", F.col("ret") >= 0)


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Change from this close to the one `h` rows ahead; null at the end of the series."""
    return bars.withColumns(
        {
            f"target_{h}": ratio(F.lead("close", h).over(by_date()), F.col("close")) - 1
            for h in horizons
        }
    )
