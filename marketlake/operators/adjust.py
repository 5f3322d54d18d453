"""Split adjustment of prices, and the corporate actions that feed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlake.schemas import PRICE_COLUMNS


def split_intervals(splits: DataFrame, index_only: bool = False) -> DataFrame:
    """Disjoint date ranges per ticker with the factor that applies before each split.

    A row covers [valid_from, valid_to); valid_from is null for the oldest range. Factors
    build up from the newest split backwards: 1 / (ratio * ratio * ...). A split without
    ticker, date or ratio says nothing and is left out.
    """
    splits = splits.dropna(subset=["ticker", "date", "ratio"])
    if index_only:
        splits = splits.filter("in_index")
    newest_first = W.partitionBy("ticker").orderBy(F.desc("date"))
    so_far = newest_first.rowsBetween(W.unboundedPreceding, W.currentRow)
    same_day = splits.groupBy(F.upper("ticker").alias("ticker"), "date").agg(
        F.product("ratio").alias("ratio")
    )
    return same_day.select(
        "ticker",
        F.lead("date").over(newest_first).alias("valid_from"),
        F.col("date").alias("valid_to"),
        F.product("ratio").over(so_far).alias("ratio"),
    ).withColumn("factor", 1 / F.col("ratio"))


def factors_by_interval(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """Bars with the ratio of the interval they fall into, by a join that Spark is free to choose.

    The intervals of a ticker are disjoint, so a bar matches one of them at most. The result is that
    of `factors_by_merge`.
    """
    b, i = bars.alias("b"), intervals.alias("i")
    within = (
        (F.upper("b.ticker") == F.col("i.ticker"))
        & (F.col("b.date") < F.col("i.valid_to"))
        & (F.col("i.valid_from").isNull() | (F.col("b.date") >= F.col("i.valid_from")))
    )
    priced = b.join(i, within, "left").select(
        "b.*", F.coalesce("i.ratio", F.lit(1.0)).alias("split_ratio")
    )
    touched = intervals.select(F.col("ticker").alias("_t")).distinct()
    return priced.join(touched, F.upper(priced["ticker"]) == F.col("_t"), "left").select(
        "split_ratio", *bars.columns, F.col("_t").isNotNull().alias("split_adjusted")
    )


def factors_by_ladder(bars: DataFrame, intervals: DataFrame, canonical: bool = False) -> DataFrame:
    """The same with the intervals of a ticker in one row, oldest first, so that bars join on the ticker alone.

    A bar takes the first interval that ends after it. Bars keep how they are partitioned: the join needs them by ticker, which is what
    the windows that follow need, or not at all where Spark finds the intervals small enough to broadcast. A ticker has no more intervals
    than it has days. With `canonical`, the tickers of `bars` are in upper case already.
    """
    steps = intervals.groupBy(F.col("ticker").alias("_t")).agg(
        F.array_sort(F.collect_list(F.struct("valid_to", "ratio"))).alias("_steps")
    )
    next_step = F.get(F.filter("_steps", lambda s: s["valid_to"] > F.col("date")), F.lit(0))["ratio"]
    ticker = bars["ticker"] if canonical else F.upper(bars["ticker"])
    joined = bars.join(steps, ticker == F.col("_t"), "left")
    return joined.select(
        F.coalesce(next_step, F.lit(1.0)).alias("split_ratio"), *bars.columns, F.col("_t").isNotNull().alias("split_adjusted")
    )


def factors_by_merge(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """Bars with the cumulative ratio of the splits after them: one pass over both by date.

    Going back in time per ticker, each bar keeps the ratio of the last split seen. On the day
    of a split the bar comes first, as it is not scaled. A bar without date is before no split and
    keeps the ratio 1. Bars without ticker have no splits; they are spread over tasks by date.
    """
    marks = intervals.select(
        F.col("ticker").alias("_t"), F.col("valid_to").alias("date"), F.col("ratio").alias("_ratio")
    )
    tagged = bars.withColumns({"_t": F.upper("ticker"), "_bar": F.lit(True)})
    merged = tagged.unionByName(marks, allowMissingColumns=True)
    merged = merged.withColumn("_spread", F.when(F.col("_t").isNull(), F.xxhash64("date")))
    ticker = W.partitionBy("_t", "_spread")
    back = ticker.orderBy(F.desc("date"), F.desc_nulls_last("_bar"))
    last_split = F.last("_ratio", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    any_split = F.count("_ratio").over(ticker) > 0
    return (
        merged.withColumns(
            {
                "split_ratio": F.when(F.col("date").isNull(), 1.0).otherwise(F.coalesce(last_split, F.lit(1.0))),
                "split_adjusted": any_split,
            }
        )
        .filter("_bar")
        .select("split_ratio", *bars.columns, "split_adjusted")
    )


def adjust_prices(
    bars: DataFrame,
    splits: DataFrame,
    index_only: bool = True,
    volume_mode: str = "keep",
    canonical: bool = False,
) -> DataFrame:
    """Bars with prices before each split scaled down, and a `split_adjusted` flag.

    `volume_mode` is "keep" or "multiply" (volume times the cumulative ratio). The flag tells
    whether the ticker has any applicable split, also when no bar is older than it. With `canonical`, the tickers of
    `bars` are in upper case already; otherwise any case will do.
    """
    if volume_mode not in ("keep", "multiply"):
        raise ValueError(f"unknown volume_mode {volume_mode!r}")
    factored = factors_by_ladder(bars, split_intervals(splits, index_only), canonical)
    factor = 1 / F.col("split_ratio")
    columns = {c: F.col(c) * factor for c in PRICE_COLUMNS if c in bars.columns}
    if volume_mode == "multiply" and "volume" in bars.columns:
        columns["volume"] = F.col("volume") * F.col("split_ratio")
    return factored.withColumns(columns).drop("split_ratio")


def adjusted_counts(adjusted: DataFrame) -> DataFrame:
    """How many tickers were adjusted and how many left unchanged."""
    per_ticker = adjusted.groupBy("ticker").agg(F.bool_or("split_adjusted").alias("touched"))
    return per_ticker.agg(
        F.count_if("touched").alias("adjusted"), F.count_if(~F.col("touched")).alias("unchanged")
    )


def classify_actions(dividends: DataFrame) -> DataFrame:
    """The kind of every corporate action, with the ratio where it amounts to a split.

    A dividend in own shares (AC) of one share or more per share held is a split:
    nine new shares for one make it ten to one.
    """
    own_shares = F.col("type") == "AC"
    kind = (
        F.when(own_shares & (F.col("amount") >= 1), "ac_split")
        .when(own_shares, "stock_dividend")
        .when(F.col("type") == "EF", "cash_dividend")
        .when(F.col("type") == "BONOS", "bond_dividend")
    )
    return dividends.withColumn("kind", kind).withColumn(
        "ratio", F.when(F.col("kind") == "ac_split", F.col("amount") + 1)
    )


def splits_from_actions(dividends: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Split rows for the actions that amount to one, less those already known.

    Index membership and confirmation are not in the dividends table, so both start as false.
    """
    found = (
        classify_actions(dividends)
        .filter(F.col("kind") == "ac_split")
        .select(
            F.upper("ticker").alias("ticker"),
            "date",
            "ratio",
            F.lit(False).alias("in_index"),
            F.lit(False).alias("verified"),
            F.lit("ac_split").alias("notes"),
        )
    )
    if known is None:
        return found
    listed = known.select(F.upper("ticker").alias("_t"), F.col("date").alias("_d"))
    return known.unionByName(found.join(listed, (found["ticker"] == F.col("_t")) & (found["date"] == F.col("_d")), "left_anti"))


def null_dirty_values(bars: DataFrame, dirty: DataFrame) -> DataFrame:
    """Known bad values set to null, with `dirty_fields` naming them.

    Only a listed field of that ticker and day is touched.
    """
    listed = dirty.groupBy(F.upper("ticker").alias("ticker"), "date").agg(
        F.array_sort(F.collect_set("field")).alias("dirty_fields")
    )
    joined = bars.alias("b").join(
        listed.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), "dirty_fields"),
        (F.upper("b.ticker") == F.col("_t")) & (F.col("b.date") == F.col("_d")),
        "left",
    ).select("b.*", "dirty_fields")
    patched = {
        c: F.when(~F.coalesce(F.array_contains("dirty_fields", c), F.lit(False)), F.col(c))
        for c in [*PRICE_COLUMNS, "volume"]
        if c in bars.columns
    }
    return joined.withColumns(patched).select(*bars.columns, "dirty_fields")


def out_of_range(bars: DataFrame, dirty: DataFrame) -> DataFrame:
    """Listed values compared with the bars: is the stored value outside its expected range?

    A listed value without a bar stays, with null as the stored value and the answer.
    """
    fields = F.create_map(
        *[x for c in [*PRICE_COLUMNS, "volume"] for x in (F.lit(c), F.col(f"b.{c}"))]
    )
    b, d = bars.alias("b"), dirty.alias("d")
    on = (F.upper("b.ticker") == F.upper("d.ticker")) & (F.col("b.date") == F.col("d.date"))
    stored = F.element_at(fields, F.col("d.field"))
    low, high = F.get("d.expected_range", F.lit(0)), F.get("d.expected_range", F.lit(1))
    return d.join(b, on, "left").select(
        F.upper("d.ticker").alias("ticker"),
        "d.date",
        "d.field",
        stored.alias("stored"),
        ((stored < low) | (stored > high)).alias("out_of_range"),
    )
