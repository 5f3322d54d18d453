"""Market tables derived from the given tables, in Spark and as SQL for the check."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.sources.events import macro_events_table, splits_table

RANGE_FROM, RANGE_TO = datetime.date(1997, 3, 1), datetime.date(1999, 9, 30)
AS_OF = datetime.date(2001, 6, 30)
TARGET = datetime.date(1999, 5, 17)

# Lists made up for the suite.
SPLITS = [
    ("S0", "1997-02-14", 3.0, False),
    ("S2", "1996-11-20", 1.3, True),
    ("S2", "1998-04-01", 4.0, True),
    ("S2", "2001-01-09", 0.5, True),
    ("S6", "1999-09-30", 1.7, False),
    ("S8", "1995-06-12", 2.3, True),
    ("S8", "1997-12-03", 8.0, False),
    ("S9", "2000-02-29", 1.1, True),
]
MACRO_EVENTS = [
    ("1997-10-27", ["S3", "S4", "S7"], "negative"),
    ("1999-01-15", ["S0"], "positive"),
    ("2000-05-05", ["S3", "S9"], "positive"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ticker(supplier: Column) -> Column:
    return F.concat(F.lit("S"), supplier.cast("string"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        (cents * 1000 + F.col("l_quantity").cast("bigint")).alias("size"),
        "l_linenumber",
        "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item as a trade. `size` ranks the trades of a day by turnover, then by quantity;
    trades of the same size have the same price."""
    lines = _lines(spark, sf)
    return lines.select(_ticker(F.col("l_suppkey")).alias("ticker"), *lines.columns[1:])


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per ticker and day: open and close are the prices of its smallest and largest trade.

    Keys and buffers are plain numbers, so the aggregate hashes, with map-side combine; the
    ticker's text is made after it.
    """
    return (
        _lines(spark, sf)
        .groupBy("l_suppkey", "date")
        .agg(
            F.min_by("px", "size").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "size").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        .select(
            "date", "open", "high", "low", "close", "volume", _ticker(F.col("l_suppkey")).alias("ticker")
        )
    )


def composition(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar, its volume taken as the quantity held and its close cut to cents."""
    return bars(spark, sf).select(
        "date",
        "ticker",
        F.col("volume").alias("quantity"),
        (F.floor(F.col("close") * 100) / 100).alias("close"),
        F.lit("historica").alias("source"),
    )


def _per_period(spark: SparkSession, sf: str, unit: str, source: str) -> DataFrame:
    period = F.trunc("date", unit).alias("date")
    held = trades(spark, sf).groupBy(period, "ticker").agg(F.sum("l_quantity").alias("quantity"))
    return held.withColumn("source", F.lit(source))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    return _per_period(spark, sf, "month", "proyectada")


def current(spark: SparkSession, sf: str) -> DataFrame:
    return _per_period(spark, sf, "quarter", "vigente")


def spot(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg((cents / 1000).alias("value"))
    )


def divisor(spark: SparkSession, sf: str) -> DataFrame:
    months = (F.year("date") - 1995) * 12 + F.month("date")
    first = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")
    return (
        table(spark, sf, "orders")
        .select(first)
        .distinct()
        .select("date", (10 * months + 1000.7).alias("divisor"))
    )


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("EF"), F.lit("AC"), F.lit("BONOS")), F.col("l_linenumber") % 3 + 1)
    return trades(spark, sf).select(
        "ticker", (F.floor("px") / 1000).alias("amount"), "date", kind.alias("type")
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Bars whose open is far above the close, with the range their open should lie in."""
    return (
        bars(spark, sf)
        .filter(F.col("open") > 10 * F.col("close"))
        .select(
            "ticker",
            "date",
            F.lit("open").alias("field"),
            F.col("open").alias("value"),
            F.array(F.col("close") / 2, F.col("close") * 2).alias("expected_range"),
            F.lit("").alias("notes"),
        )
    )


def splits(spark: SparkSession) -> DataFrame:
    return splits_table(
        spark,
        [{"ticker": t, "date": d, "ratio": r, "in_index": i} for t, d, r, i in SPLITS],
    )


def macro_events(spark: SparkSession) -> DataFrame:
    return macro_events_table(
        spark, [{"date": d, "tickers_affected": t, "direction": k} for d, t, k in MACRO_EVENTS]
    )


def settlements(spark: SparkSession, sf: str) -> DataFrame:
    """First trading day of each month."""
    return spot(spark, sf).groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response body per ticker holding all its bars."""
    numbers = F.struct("date", "open", "high", "low", "close", "volume")

    def record(bar: Column) -> Column:
        return F.struct(
            bar["close"].alias("c"),
            F.concat(bar["date"].cast("string"), F.lit("T00:00:00Z")).alias("d"),
            bar["high"].alias("h"),
            bar["low"].alias("l"),
            bar["open"].alias("o"),
            F.lit("D").alias("r"),
            F.concat(F.lit("bm_MERV_"), F.col("ticker"), F.lit("_24hs")).alias("sid"),
            bar["volume"].alias("v"),
        )

    # The text of a record is made once its numbers are collected, so that it is not shuffled.
    held = bars(spark, sf).groupBy("ticker").agg(F.collect_list(numbers).alias("bars"))
    series = held.select("ticker", F.transform("bars", record).alias("series"))
    envelope = F.struct(F.lit("2024-01-01T00:00:00Z").alias("nextTime"), F.lit(False).alias("noData"), "series")
    return series.select("ticker", F.to_json(envelope).alias("body"))


def mixed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Some bodies broken in the ways a service may answer, by the last digit of the ticker."""
    digit = F.substring("ticker", -1, 1)
    body = (
        F.when(digit == "1", F.lit("[]"))
        .when(digit == "2", F.lit('{"nextTime": null, "noData": false}'))
        .when(digit == "3", F.lit('{"series": {"c": 1.0}}'))
        .when(digit == "4", F.lit('{"nextTime": null, "noData": true, "series": []}'))
        .otherwise(F.col("body"))
    )
    return responses(spark, sf).select("ticker", body.alias("body"))


_CTE = {
    "trades": """
        SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
               CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT) AS size,
               l_linenumber, l_quantity, l_extendedprice / l_quantity AS px
        FROM lineitem""",
    "ohlcv": """
        SELECT date, min_by(px, size) AS open, max(px) AS high, min(px) AS low, max_by(px, size) AS close,
               sum(l_quantity) AS volume, ticker
        FROM trades GROUP BY ticker, date""",
    "composition": """
        SELECT date, ticker, volume AS quantity, floor(close * 100) / 100 AS close, 'historica' AS source FROM ohlcv""",
    "projected": """
        SELECT CAST(date_trunc('month', date) AS DATE) AS date, ticker, sum(l_quantity) AS quantity,
               'proyectada' AS source
        FROM trades GROUP BY 1, 2""",
    "current_comp": """
        SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, ticker, sum(l_quantity) AS quantity,
               'vigente' AS source
        FROM trades GROUP BY 1, 2""",
    "spot": """
        SELECT CAST(o_orderdate AS DATE) AS date,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / 1000 AS value
        FROM orders GROUP BY 1""",
    "divisor": """
        SELECT date, 10 * ((year(date) - 1995) * 12 + month(date)) + CAST(1000.7 AS DOUBLE) AS divisor
        FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders)""",
    "dividends": """
        SELECT ticker, floor(px) / 1000 AS amount, date,
               CASE l_linenumber % 3 WHEN 0 THEN 'EF' WHEN 1 THEN 'AC' ELSE 'BONOS' END AS type
        FROM trades""",
    "dirty": """
        SELECT ticker, date, 'open' AS field, open AS value, close / 2 AS low_ok, close * 2 AS high_ok
        FROM ohlcv WHERE open > 10 * close""",
    "splits": "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', DATE '{d}', CAST({r} AS DOUBLE), {i})" for t, d, r, i in SPLITS)
    + ") AS s(ticker, date, ratio, in_index)",
    "macro": "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', DATE '{d}', '{k}')" for d, ts, k in MACRO_EVENTS for t in ts)
    + ") AS m(ticker, date, direction)",
    "settlements": "SELECT min(date) AS date FROM spot GROUP BY date_trunc('month', date)",
    "rets": """
        SELECT ticker, date, close, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS ret
        FROM ohlcv WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "actions": """
        SELECT *, CASE WHEN type = 'AC' AND amount >= 1 THEN 'ac_split' WHEN type = 'AC' THEN 'stock_dividend'
                       WHEN type = 'EF' THEN 'cash_dividend' ELSE 'bond_dividend' END AS kind,
               CASE WHEN type = 'AC' AND amount >= 1 THEN amount + 1 END AS ratio
        FROM dividends""",
    "action_days": """
        SELECT ticker, date, product(ratio) AS ratio FROM actions WHERE kind = 'ac_split' GROUP BY ticker, date""",
    "gaps": """
        SELECT ticker AS instrument, date, open, close, prev_close,
               (open - prev_close) / prev_close * 100 AS gap, rn, n
        FROM (SELECT *, lag(close) OVER w AS prev_close, row_number() OVER w AS rn,
                     count(*) OVER (PARTITION BY ticker) AS n
              FROM ohlcv WINDOW w AS (PARTITION BY ticker ORDER BY date))""",
    "alerts": """
        SELECT *, strftime(date, '%d/%m/%Y') AS date_str,
               CASE WHEN gap < 0 THEN 'split_candidato' ELSE 'split_inverso_candidato' END AS tipo,
               round_even(gap, 2) AS variacion_pct,
               round_even(CASE WHEN gap < 0 THEN prev_close / open ELSE open / prev_close END, 4) AS ratio_implicito
        FROM gaps WHERE abs(gap) > 30""",
    "weights": """
        SELECT c.*, t.total, c.close * c.quantity / t.total * 100 AS weight,
               year(c.date) || '-Q' || quarter(c.date) AS quarter
        FROM composition c
        JOIN (SELECT date, sum(close * quantity) AS total FROM composition GROUP BY date) t ON c.date = t.date
        WHERE t.total > 0""",
}

_NEEDS = {
    "ohlcv": ["trades"],
    "composition": ["ohlcv"],
    "projected": ["trades"],
    "current_comp": ["trades"],
    "dividends": ["trades"],
    "dirty": ["ohlcv"],
    "settlements": ["spot"],
    "rets": ["ohlcv"],
    "actions": ["dividends"],
    "action_days": ["actions"],
    "gaps": ["ohlcv"],
    "alerts": ["gaps"],
    "weights": ["composition"],
}


def sql(names: str, body: str) -> str:
    """`body` preceded by the named tables (space-separated) and all they are derived from."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in _NEEDS.get(name, []):
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({_CTE[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}"
