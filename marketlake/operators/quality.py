"""Coverage figures, run totals and calendar alignment."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions import business_days
from marketlake.operators.returns import by_date
from marketlake.plans.joins import join_by_date


def ticker_stats(bars: DataFrame) -> DataFrame:
    """Rows, date range, expected Monday-to-Friday days in it and how many of those lack a bar."""
    counted = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.count_if(F.weekday("date") < 5).alias("_working"),
    )
    expected = business_days(F.col("date_min"), F.col("date_max"))
    return counted.withColumn("expected_bdays", expected).select(
        "ticker",
        "n_rows",
        "date_min",
        "date_max",
        "expected_bdays",
        (F.col("expected_bdays") - F.col("_working")).alias("missing_bdays"),
    )


def coverage_matrix(
    bars: DataFrame, years: range | None = None, tickers: DataFrame | None = None
) -> DataFrame:
    """Rows per ticker and year in percent of that year's largest count, one decimal.

    `tickers` may name tickers without any bars; they get zeros. Each ticker is expanded by the
    list of years, those with bars unless `years` are given, and the yearly maxima are one row per year.
    """
    by_year = bars.groupBy("ticker", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    peaks = by_year.groupBy("year").agg(F.max("n").alias("peak"))
    named = bars.select("ticker") if tickers is None else tickers.select("ticker")
    if years is None:
        span = peaks.filter("year IS NOT NULL").agg(F.array_sort(F.collect_list("year")).alias("years")).scalar()
    else:
        span = F.array(*[F.lit(y) for y in years])
    grid = named.distinct().withColumn("year", F.explode(span))
    joined = join_by_date(grid.join(by_year, ["ticker", "year"], "left"), peaks, on="year")
    share = F.coalesce("n", F.lit(0)) / F.coalesce("peak", F.lit(1)) * 100
    return joined.select("ticker", "year", F.bround(share, 1).alias("coverage"))


def listed_tickers(bars: DataFrame) -> DataFrame:
    """The tickers present, in upper case and order. `bars` may as well be the ledger of a store, which has far fewer rows."""
    return bars.select(F.upper("ticker").alias("ticker")).distinct().orderBy("ticker")


def bars_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.countDistinct("ticker").alias("n_tickers"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )


def last_update(stored: DataFrame) -> DataFrame:
    """Time of the newest file behind a stored table, or behind some of its rows: every row is looked at.

    `sources.store.update_batches` tells the same of whole tables from the file listing.
    """
    return stored.select(F.col("_metadata.file_modification_time").alias("t")).agg(
        F.max("t").alias("last_update")
    )


def run_totals(status: DataFrame) -> DataFrame:
    """Succeeded, failed and all tickers of a run status table (ticker, ok, ...)."""
    return status.agg(
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.count(F.lit(1)).alias("n_total"),
    )


def failed_tickers(status: DataFrame) -> DataFrame:
    """One row per failed ticker; a table, since there may be many."""
    return status.filter(~F.col("ok")).select("ticker", "reason")


def align_to_calendar(bars: DataFrame, holidays: list[datetime.date] | None = None) -> DataFrame:
    """Each ticker on every business day of its own range, with `missing` where it has no bar.

    Each bar is spread over the business days up to the next bar, so no grid is joined. Values
    are null on missing days; bars on other days are left out.
    """
    following = F.lead("date").over(by_date())
    values = [c for c in bars.columns if c not in ("ticker", "date")]
    until = F.coalesce(F.date_sub("_next", 1), F.col("date"))
    days = bars.withColumn("_next", following).withColumn(
        "_day", F.explode(F.sequence("date", until))
    )
    open_day = F.weekday("_day") < 5
    if holidays:
        open_day = open_day & ~F.col("_day").isin(*holidays)
    own = F.col("_day") == F.col("date")
    return days.filter(open_day).select(
        "ticker",
        F.col("_day").alias("date"),
        *[F.when(own, F.col(c)).alias(c) for c in values],
        (~own).alias("missing"),
    )
