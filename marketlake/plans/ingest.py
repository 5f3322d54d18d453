"""Landed responses into the stored bars, skipping what is already there.

What is stored is looked up in a ledger, which each batch writes and commits along with its bars: for every ticker the first and last date and
the number of bars. Stored bars are read only where a batch brings dates within the range that its ticker has already.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators.selection import date_range
from marketlake.plans.scratch import written
from marketlake.schemas import LEDGER, OHLCV, OHLCV_COLUMNS
from marketlake.sinks.tables import by_ticker
from marketlake.sources import store
from marketlake.sources.responses import as_numbers, bars_of, validated

BARS = "ohlcv"


def stored_bars(spark: SparkSession, root: str, version: str = "v1") -> DataFrame:
    """The stored bars, or an empty table before the first ingest."""
    try:
        return store.load_table(spark, root, "raw", BARS, version, OHLCV)
    except FileNotFoundError:
        return spark.createDataFrame([], OHLCV)


def stored_ledger(spark: SparkSession, root: str, version: str = "v1") -> DataFrame:
    """(ticker, date_min, date_max, rows) of the stored bars, without reading them."""
    return store.ledger(spark, store.table_path(root, "raw", BARS, version), OHLCV)


def one_per_day(bars: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """One bar per ticker and date, the same one on every run: of different bars the smallest in the order of their columns.

    A hashed aggregate of plain numbers finds the days whose bars differ; only those are compared. One bar of each day is kept in the
    scratch folder, with a mark whether the day's bars are alike: none of a column differ, and the same columns are null. The others are read from
    `among`, which may hold bars of other days besides, where that takes less work.
    """
    values = ["open", "high", "low", "close", "volume"]
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(values)])
    found = bars.groupBy("ticker", "date").agg(
        F.min(nulls).alias("_nulls"),
        F.max(nulls).alias("_max_nulls"),
        *[F.min(c).alias(c) for c in values],
        *[F.max(c).alias(f"_max_{c}") for c in values],
    )
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_max_{c}")) for c in values], F.col("_nulls") == F.col("_max_nulls"))
    days = written(found.select(*OHLCV_COLUMNS, alike.alias("_alike")), "days")
    clear, differ = days.filter("_alike").select(*OHLCV_COLUMNS), days.filter("NOT _alike").select(F.col("ticker").alias("_t"), F.col("date").alias("_d"))
    if differ.isEmpty():
        return clear
    among = bars if among is None else among
    several = among.join(differ, among["ticker"].eqNullSafe(F.col("_t")) & among["date"].eqNullSafe(F.col("_d")), "left_semi")
    best = several.groupBy("ticker", "date").agg(F.min(F.struct(*values)).alias("_bar"))
    return clear.unionByName(best.select("date", "_bar.*", "ticker"))


def take_in(bars: DataFrame, root: str, version: str = "v1", extend: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stores the bars that are new, and commits them with their ledger; the ledger as it was before, and that of the new bars.

    Bars of a ticker that is not stored, or of dates before or after its stored ones, are new. The others are looked up
    among the stored bars of their tickers, before anything else is done with them. Without `extend`, a ticker of which anything is stored gets nothing new. Where nothing is
    stored at all, nothing is looked up. A batch that fails midway is never seen, and running it again stores it as if for the first time.
    """
    spark, path = bars.sparkSession, store.table_path(root, "raw", BARS, version)
    had, new = stored_ledger(spark, root, version), bars
    if store.table_exists(spark, root, "raw", BARS, version):
        new = _unseen(bars, had, root, version, extend)
    folder, rows = store.write_part(by_ticker(one_per_day(new, bars)), path)
    if rows == 0:
        return had, spark.createDataFrame([], LEDGER)
    batch = store.save_ledger(spark, path, folder, OHLCV)
    store.commit(spark, path, [(folder, folder, rows)], ledger=True)
    return had, batch


def _unseen(incoming: DataFrame, had: DataFrame, root: str, version: str, extend: bool) -> DataFrame:
    """The incoming bars that are new to a store with the ledger `had`."""
    spark = incoming.sparkSession
    known = had.select(F.col("ticker").alias("_t"), "date_min", "date_max", F.lit(True).alias("_known"))
    seen = incoming.join(known, incoming["ticker"].eqNullSafe(F.col("_t")), "left")
    is_known = F.coalesce("_known", F.lit(False))
    within = is_known & F.col("date").between(F.col("date_min"), F.col("date_max"))
    fresh = seen.filter(~within if extend else ~is_known).select(*OHLCV_COLUMNS)
    inside = seen.filter(within).select(*OHLCV_COLUMNS)
    if extend and not inside.isEmpty():
        fresh = fresh.unionByName(_absent(inside, stored_bars(spark, root, version)))
    return fresh


def _absent(inside: DataFrame, stored: DataFrame) -> DataFrame:
    """The bars whose ticker and date are not stored; of the stored bars only those of these tickers are looked at."""
    tickers = inside.select(F.col("ticker").alias("_t")).distinct()
    theirs = stored.join(tickers, stored["ticker"].eqNullSafe(F.col("_t")), "left_semi")
    theirs = theirs.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"))
    return inside.join(theirs, inside["ticker"].eqNullSafe(F.col("_t")) & (inside["date"] == F.col("_d")), "left_anti")


def ingest(
    responses: DataFrame,
    root: str,
    date_from: datetime.date,
    date_to: datetime.date,
    version: str = "v1",
    extend: bool = True,
) -> DataFrame:
    """Store the new bars of all requested tickers; returns (ticker, ok, rows, reason).

    A ticker fails only on an invalid or unreadable response. Stored tickers and empty responses succeed.
    Should the write fail midway, nothing of it counts, and running it again stores all. With
    `extend` false a ticker of which anything is stored is left as it is. Bodies are parsed once.
    """
    if date_from > date_to:
        raise ValueError(f"date_from {date_from} is after date_to {date_to}")
    checked = written(as_numbers(validated(responses)), "responses")
    if checked.isEmpty():
        raise ValueError("no tickers requested")
    had, batch = take_in(date_range(bars_of(checked), date_from, date_to), root, version, extend)
    return _status(checked, had, batch)


def _status(checked: DataFrame, had: DataFrame, batch: DataFrame) -> DataFrame:
    asked = checked.groupBy("ticker").agg(F.bool_and("valid").alias("valid"), F.bool_and("readable").alias("readable"))
    before = had.select(F.col("ticker").alias("_h"), F.col("rows").alias("had"))
    now = batch.select(F.col("ticker").alias("_b"), F.col("rows").alias("new"))
    joined = asked.join(before, F.col("ticker").eqNullSafe(F.col("_h")), "left").join(
        now, F.col("ticker").eqNullSafe(F.col("_b")), "left"
    )
    stored = F.coalesce("had", F.lit(0)) > 0
    rows = F.coalesce("new", F.lit(0).cast("bigint"))
    reason = (
        F.when((rows > 0) & stored, "extended")
        .when(rows > 0, "written")
        .when(stored, "already stored")
        .when(F.col("readable"), "no rows in range")
        .when(F.col("valid"), "unreadable record")
        .otherwise("invalid response")
    )
    return joined.select(
        "ticker", (stored | F.col("readable")).alias("ok"), rows.alias("rows"), reason.alias("reason")
    )
