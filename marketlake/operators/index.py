"""Index composition: as-of lookup, weights, presence, and reconstruction of the index value."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlake.functions import quarter_label, ratio
from marketlake.operators.selection import trailing_range
from marketlake.plans.joins import join_by_date


def market_cap() -> Column:
    return F.coalesce("close", F.lit(0.0)) * F.coalesce("quantity", F.lit(0.0))


def composition_at(composition: DataFrame, target: datetime.date) -> DataFrame:
    """The composition of the newest date not after `target`.

    One small aggregate finds the date; it then filters the scan as a constant.
    """
    found = composition.filter(F.col("date") <= F.lit(target)).agg(F.max("date")).first()[0]
    if found is None:
        raise ValueError(f"no composition on or before {target}")
    return composition.filter(F.col("date") == F.lit(found))


def as_of_dates(targets: DataFrame, available: DataFrame) -> DataFrame:
    """(date, resolved): for each target date the newest available date not after it, else null.

    Both sides are reduced to distinct dates first, so the one ordered pass is over calendar
    days, not over facts.
    """
    wanted = targets.select("date", F.lit(True).alias("_wanted"), F.lit(None).cast("date").alias("_has"))
    present = available.select("date", F.lit(False).alias("_wanted"), F.col("date").alias("_has"))
    days = (
        wanted.unionByName(present)
        .groupBy("date")
        .agg(F.bool_or("_wanted").alias("_wanted"), F.max("_has").alias("_has"))
    )
    back = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    resolved = days.select("date", "_wanted", F.max("_has").over(back).alias("resolved"))
    return resolved.filter("_wanted").drop("_wanted")


def compositions_at(composition: DataFrame, targets: DataFrame) -> DataFrame:
    """Composition rows for many target dates, each with the date it was resolved to.

    Only compositions that some target resolves to pass the join.
    """
    map_ = as_of_dates(targets, composition).filter(F.col("resolved").isNotNull())
    rows = composition.withColumnRenamed("date", "resolved")
    return join_by_date(rows, map_, on="resolved", how="inner")


def total_market_cap(composition: DataFrame) -> DataFrame:
    return composition.groupBy("date").agg(F.sum(market_cap()).alias("total"))


def daily_weights(composition: DataFrame) -> DataFrame:
    """Weight in percent per ticker and day; days with a total of zero or less are dropped."""
    totals = total_market_cap(composition).filter(F.col("total") > 0)
    rows = join_by_date(composition, totals, how="inner")
    return rows.withColumn("weight", market_cap() / F.col("total") * 100)


def quarterly_weights(composition: DataFrame) -> DataFrame:
    """Mean daily weight per quarter, over the days on which the ticker was present."""
    return (
        daily_weights(composition)
        .withColumn("quarter", quarter_label(F.col("date")))
        .groupBy("quarter", "ticker")
        .agg(F.avg("weight").alias("weight"))
    )


def weight_matrix(composition: DataFrame) -> DataFrame:
    """Quarterly weights on the full ticker by quarter grid, 0 where absent.

    Each ticker's weights go into one map, over which the list of quarters is spread; the calendar bounds both. The list comes from the
    daily totals, so the weights are computed once.
    """
    days = total_market_cap(composition).filter(F.col("total") > 0)
    quarters = days.agg(F.array_sort(F.collect_set(quarter_label(F.col("date")))).alias("quarters")).scalar()
    entry = F.struct("quarter", "weight")
    held = quarterly_weights(composition).groupBy("ticker").agg(F.map_from_entries(F.collect_list(entry)).alias("held"))
    return held.select("ticker", "held", F.explode(quarters).alias("quarter")).select(
        "ticker", "quarter", F.coalesce(F.col("held")[F.col("quarter")], F.lit(0.0)).alias("weight")
    )


def presence_matrix(composition: DataFrame) -> DataFrame:
    """1 where the ticker was in the index at some day of the quarter, else 0."""
    seen = composition.select("ticker", quarter_label(F.col("date")).alias("quarter"))
    quarters = seen.agg(F.array_sort(F.collect_set("quarter")).alias("quarters")).scalar()
    held = seen.groupBy("ticker").agg(F.collect_set("quarter").alias("held"))
    return held.select("ticker", "held", F.explode(quarters).alias("quarter")).select(
        "ticker", "quarter", F.array_contains("held", F.col("quarter")).cast("int").alias("present")
    )


def weights_at(composition: DataFrame, target: datetime.date) -> DataFrame:
    """Composition at a date with the estimated weight in percent, two decimals.

    The weight is null when the total is not positive.
    """
    day = composition_at(composition, target)
    total = day.agg(F.sum(market_cap())).scalar()
    weight = F.when(total > 0, F.round(market_cap() / F.nullif(total, F.lit(0.0)) * 100, 2))
    return day.withColumn("weight", weight)


def dataset_summary(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct tickers (null without a ticker column) and date range of each table."""
    rows = []
    for name, df in datasets.items():
        tickers = F.countDistinct("ticker") if "ticker" in df.columns else F.lit(None).cast("long")
        rows.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                tickers.alias("n_tickers"),
                F.min("date").alias("date_min"),
                F.max("date").alias("date_max"),
            ).withColumn("dataset", F.lit(name))
        )
    return reduce(lambda a, b: a.unionByName(b), rows)


def unique_tickers(sources: dict[str, DataFrame], chosen: list[str] | None = None) -> DataFrame:
    """Distinct tickers over the chosen composition sources; an unknown name is passed over."""
    frames = [sources[c].select("ticker") for c in chosen or ["historica"] if c in sources]
    if not frames:
        return next(iter(sources.values())).select("ticker").limit(0)
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def source_coverage(sources: dict[str, DataFrame], chosen: list[str] | None = None) -> DataFrame:
    """Date range and number of distinct dates per source."""
    rows = [
        sources[c]
        .agg(
            F.min("date").alias("date_min"),
            F.max("date").alias("date_max"),
            F.countDistinct("date").alias("n_dates"),
        )
        .withColumn("source", F.lit(c))
        for c in chosen or ["historica"]
        if c in sources
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def index_summary(spot: DataFrame, divisor: DataFrame) -> DataFrame:
    """First and last day, days, lowest and highest value, and the latest divisor.

    One pass over each table; both results have a single row.
    """
    current = divisor.agg(F.max_by("divisor", "date")).scalar()
    return spot.agg(
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.count(F.lit(1)).alias("n_days"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
    ).withColumn("current_divisor", current)


def spot_with_divisor(
    spot: DataFrame, divisor: DataFrame, label: str, as_of: datetime.date
) -> DataFrame:
    """Both series clipped to one trailing range, on a common date axis."""
    left = trailing_range(spot, label, as_of)
    right = trailing_range(divisor, label, as_of)
    return left.join(right, "date", "full_outer").select("date", "value", "divisor")


def reconstructed_index(composition: DataFrame, divisor: DataFrame, spot: DataFrame) -> DataFrame:
    """Index value rebuilt from the composition and the divisor in force, next to the spot value.

    Everything after the first aggregate has one row per day.
    """
    totals = total_market_cap(composition)
    in_force = as_of_dates(totals, divisor).join(
        divisor.select(F.col("date").alias("resolved"), "divisor"), "resolved"
    )
    rebuilt = totals.join(in_force, "date").withColumn(
        "rebuilt", ratio(F.col("total"), F.col("divisor"))
    )
    return (
        rebuilt.join(spot, "date", "left")
        .withColumn("difference", F.col("rebuilt") - F.col("value"))
        .select("date", "total", "divisor", "rebuilt", "value", "difference")
    )
