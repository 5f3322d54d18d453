"""Overnight price jumps: detection, context, classification and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from marketlake.functions import normal_ticker, ratio, without_nan
from marketlake.operators.digest import DAY_WORDS, days_digest
from marketlake.plans.scratch import checkpointed

# Alert types and membership labels of the report.
FALL = "split_candidato"
RISE = "split_inverso_candidato"
IN_INDEX = "Sí"
NOT_IN_INDEX = "No"

THRESHOLD = 30.0
CONTEXT_ROWS = 3


def by_date() -> WindowSpec:
    """The rows of one instrument in order of date."""
    return W.partitionBy("instrument").orderBy("date")


def scan_rows(bars: DataFrame, canonical: bool = False) -> DataFrame:
    """Stored bars as (instrument, date, open, close), unusable rows dropped.

    A missing open falls back to the close. A table without ticker, close or date gives none. With `canonical`, tickers are
    in upper case already; they are then taken as they are, so rows that lie together by ticker need not be dealt again.
    """
    if not {"ticker", "close", "date"} <= set(bars.columns):
        session = bars.sparkSession
        return session.createDataFrame([], "instrument string, date date, open double, close double")
    close = without_nan(F.col("close").cast("double"))
    opened = without_nan(F.col("open").cast("double")) if "open" in bars.columns else F.lit(None)
    ticker = F.col("ticker") if canonical else normal_ticker(F.col("ticker"))
    rows = bars.select(
        ticker.alias("instrument"),
        F.col("date").try_cast("date").alias("date"),
        F.coalesce(opened, close).alias("open"),
        close.alias("close"),
    )
    return _nonzero(rows)


def csv_rows(lines: DataFrame) -> DataFrame:
    """Rows of the alternative CSV source; unlike stored bars, a missing open drops the row."""
    rows = lines.select(
        normal_ticker(F.col("ticker")).alias("instrument"),
        F.col("date").try_cast("date").alias("date"),
        without_nan(F.col("open").try_cast("double")).alias("open"),
        without_nan(F.col("close").try_cast("double")).alias("close"),
    )
    return _nonzero(rows)


def _nonzero(rows: DataFrame) -> DataFrame:
    return rows.dropna().filter((F.col("open") != 0) & (F.col("close") != 0))


def first_seen(sources: list[DataFrame], unique: bool = False) -> DataFrame:
    """One row per (instrument, date): the first source that has it with an open, by value within a source.

    Two aggregates with map-side combine, so many copies of one key never meet in one task. Keys and buffers have a fixed
    width, so both hash and nothing is sorted: the first leaves one close for each open of a source, the second picks the
    smallest open of every source and the close that belongs to it. With `unique`, a single source whose rows are
    unique already is taken as it is.
    """
    if unique and len(sources) == 1:
        return sources[0].select("instrument", "date", "open", "close")
    n = len(sources)
    ranked = [df.withColumn("_rank", F.lit(i) + n * F.col("open").isNull().cast("int")) for i, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), ranked)
    distinct = rows.groupBy("instrument", "date", "_rank", "open").agg(F.min("close").alias("close"))

    def of(rank: int, column: str) -> Column:
        return F.when(F.col("_rank") == rank, F.col(column))

    best = distinct.groupBy("instrument", "date").agg(
        F.min("_rank").alias("_rank"),
        *[F.min(of(i, "open")).alias(f"_open{i}") for i in range(n)],
        *[F.min_by("close", of(i, "open")).alias(f"_close{i}") for i in range(n)],
        *[F.min(of(i, "close")).alias(f"_close{i}") for i in range(n, 2 * n)],
    )
    at = F.col("_rank") + 1
    opened = F.array(*[F.col(f"_open{i}") for i in range(n)], *[F.lit(None).cast("double")] * n)
    closed = F.array(*[F.col(f"_close{i}") for i in range(2 * n)])
    return best.select("instrument", "date", F.element_at(opened, at).alias("open"), F.element_at(closed, at).alias("close"))


def overnight_gaps(rows: DataFrame) -> DataFrame:
    """Every row with the previous close and the change from it to the open, in percent."""
    prev = F.lag("close").over(by_date())
    return rows.withColumn("prev_close", prev).withColumn(
        "gap", ratio(F.col("open") - F.col("prev_close"), F.col("prev_close")) * 100
    )


def _alert_columns(gaps: DataFrame, threshold: float, *extra: str | Column) -> DataFrame:
    fell = F.col("gap") < 0
    implied = F.when(fell, ratio(F.col("prev_close"), F.col("open"))).otherwise(
        ratio(F.col("open"), F.col("prev_close"))
    )
    return gaps.filter((F.abs("gap") > threshold) & (F.col("open") != 0)).select(
        "instrument",
        "date",
        F.date_format("date", "dd/MM/yyyy").alias("date_str"),
        F.when(fell, FALL).otherwise(RISE).alias("tipo"),
        F.bround("gap", 2).alias("variacion_pct"),
        F.bround(implied, 4).alias("ratio_implicito"),
        "prev_close",
        F.col("open").alias("open_next"),
        *extra,
    )


def detect_gaps(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Opens that differ from the previous row's close by more than `threshold` percent."""
    return _alert_columns(overnight_gaps(rows), threshold)


def detect_gaps_with_context(
    rows: DataFrame, threshold: float = THRESHOLD, reach: int = CONTEXT_ROWS
) -> DataFrame:
    """Alerts with the rows around them, `reach` to either side, as an array of records.

    The values around a row are offsets in the one window that finds the previous close; arrays and texts are made of them for
    alerts only.
    """
    steps = range(-reach, reach + 1)
    at = {
        (c, k): F.lag(c, -k).over(by_date()).alias(f"_{c}_{k + reach + 1}")
        for c in ("date", "open", "close")
        for k in ([-reach - 1, *steps] if c == "close" else steps)
    }
    prev = F.lag("close").over(by_date()).alias("prev_close")
    around = rows.select("*", prev, *at.values())
    gap = ratio(F.col("open") - F.col("prev_close"), F.col("prev_close")) * 100
    name = lambda c, k: F.col(f"_{c}_{k + reach + 1}")
    held = [name(c, k).alias(f"_{c}_{k + reach + 1}") for c, k in at]
    alerts = _alert_columns(around.withColumn("gap", gap), threshold, *held)
    records = [
        F.when(
            name("date", k).isNotNull(),
            F.struct(
                F.date_format(name("date", k), "dd/MM/yyyy").alias("fecha"),
                name("open", k).alias("open"),
                name("close", k).alias("close"),
                F.bround(ratio(name("close", k) - name("close", k - 1), name("close", k - 1)) * 100, 2).alias("var_dia_pct"),
                F.lit(k == 0).alias("is_event"),
            ),
        )
        for k in steps
    ]
    context = F.filter(F.array(*records), lambda r: r.isNotNull())
    kept = [c for c in alerts.columns if not c.startswith(("_date_", "_open_", "_close_"))]
    return alerts.select(*kept, context.alias("context"))


def membership(composition: DataFrame) -> DataFrame:
    """Distinct (ticker, date) pairs in the index; empty when the columns are missing."""
    if not {"ticker", "date"} <= set(composition.columns):
        return composition.sparkSession.createDataFrame([], "ticker string, date date")
    return (
        composition.select(
            normal_ticker(F.col("ticker")).alias("ticker"),
            F.col("date").try_cast("date").alias("date"),
        )
        .dropna()
        .distinct()
    )


def flag_membership(alerts: DataFrame, composition: DataFrame | None) -> DataFrame:
    """`en_indice`: whether the instrument was in the index that day; null without composition."""
    if composition is None:
        return alerts.withColumn("en_indice", F.lit(None).cast("string"))
    members = membership(composition).select(
        F.col("ticker").alias("instrument"), "date", F.lit(True).alias("_member")
    )
    label = F.when(F.col("_member"), IN_INDEX).otherwise(NOT_IN_INDEX)
    joined = alerts.join(members, ["instrument", "date"], "left")
    return joined.withColumn("en_indice", label).drop("_member")


def alert_totals(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("tipo", "en_indice").agg(F.count(F.lit(1)).alias("n"))


def analysed_totals(rows: DataFrame) -> DataFrame:
    """What was looked at: rows, distinct instruments, distinct dates; exact, in one pass over the rows.

    All three come from a digest with a row per instrument and year, which is kept in the checkpoint folder.
    """
    digest = checkpointed(days_digest(rows, "instrument"))
    years = digest.groupBy("year").agg(*[F.bit_or(w).alias(w) for w in DAY_WORDS])
    days = reduce(lambda a, b: a + b, [F.bit_count(w) for w in DAY_WORDS])
    n_dates = years.filter("year IS NOT NULL").agg(F.coalesce(F.sum(days.cast("bigint")), F.lit(0).cast("bigint"))).scalar()
    per_instrument = digest.groupBy("instrument").agg(F.sum("n").alias("n"))
    return per_instrument.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_rows"), F.count("instrument").alias("n_instruments")
    ).withColumn("n_dates", n_dates)


def report(flagged: DataFrame) -> DataFrame:
    """The columns of the exported report."""
    return flagged.select(
        F.col("instrument").alias("ticker"),
        F.col("date_str").alias("fecha"),
        "tipo",
        "variacion_pct",
        "ratio_implicito",
        F.coalesce("en_indice", F.lit("")).alias("en_indice"),
    )


def exploded_events(events: DataFrame) -> DataFrame:
    """One row per (ticker, date, direction) of the macro events."""
    return events.select(
        F.explode("tickers_affected").alias("ticker"), "date", "direction"
    ).select(F.upper("ticker").alias("ticker"), "date", "direction")


def classify_alerts(
    alerts: DataFrame, splits: DataFrame, events: DataFrame, dirty: DataFrame
) -> DataFrame:
    """Why each alert fired: a known split, a macro event, a known bad value, or unexplained.

    The three lists are matched in that order on instrument and date.
    """
    lists = [
        ("confirmed_split", splits.select(F.upper("ticker").alias("instrument"), "date")),
        ("macro_event", exploded_events(events).select(F.col("ticker").alias("instrument"), "date")),
        ("dirty_data", dirty.select(F.upper("ticker").alias("instrument"), "date")),
    ]
    known = reduce(lambda a, b: a.unionByName(b), [df.withColumn("_rank", F.lit(i)) for i, (_, df) in enumerate(lists)])
    first = known.groupBy("instrument", "date").agg(F.min("_rank").alias("_rank"))  # a number, so that it hashes
    cause = F.get(F.array(*[F.lit(c) for c, _ in lists]), F.col("_rank"))
    return (
        alerts.join(first, ["instrument", "date"], "left")
        .withColumn("cause", F.coalesce(cause, F.lit("unexplained")))
        .drop("_rank")
    )


def event_dummies(bars: DataFrame, events: DataFrame) -> DataFrame:
    """`macro_event` per bar: 1 or -1 on a positive or negative event of that ticker, in any case, else 0."""
    sign = (
        F.when(F.col("direction") == "positive", 1)
        .when(F.col("direction") == "negative", -1)
        .otherwise(0)
    )
    marks = (
        exploded_events(events)
        .groupBy(F.col("ticker").alias("_t"), F.col("date").alias("_d"))
        .agg(F.signum(F.sum(sign).cast("double")).cast("int").alias("macro_event"))
    )
    on = (normal_ticker(bars["ticker"]) == F.col("_t")) & (bars["date"] == F.col("_d"))
    joined = bars.join(marks, on, "left").drop("_t", "_d")
    return joined.withColumn("macro_event", F.coalesce("macro_event", F.lit(0)))
