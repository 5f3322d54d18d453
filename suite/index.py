"""Queries over the index composition, its weights and its value."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import index
from suite import fixtures as fx
from suite.registry import query, rounded

_SOURCES = """
SELECT 'historica' AS source, ticker, date FROM composition
UNION ALL SELECT 'proyectada', ticker, date FROM projected
UNION ALL SELECT 'vigente', ticker, date FROM current_comp"""


def sources(spark, sf):
    return {
        "historica": fx.composition(spark, sf),
        "proyectada": fx.projected(spark, sf),
        "vigente": fx.current(spark, sf),
    }


@query("J1_daily_weight", "weights", "SELECT date, ticker, round(weight, 4) AS weight FROM weights")
def j1(spark, sf):
    df = index.daily_weights(fx.composition(spark, sf))
    return rounded(df.select("date", "ticker", "weight"), "weight")


@query(
    "J3_composition_at_date",
    "projected",
    f"""SELECT * FROM projected WHERE date =
        (SELECT max(date) FROM projected WHERE date <= DATE '{fx.TARGET}')""",
)
def j3(spark, sf):
    return index.composition_at(fx.projected(spark, sf), fx.TARGET)


@query(
    "J3_compositions_at_dates",
    "projected settlements",
    """SELECT t.date, t.resolved, p.ticker, p.quantity, p.source
       FROM (SELECT s.date, max(p.date) AS resolved FROM settlements s
             JOIN (SELECT DISTINCT date FROM projected) p ON p.date <= s.date GROUP BY s.date) t
       JOIN projected p ON p.date = t.resolved""",
)
def j3_many(spark, sf):
    return index.compositions_at(fx.projected(spark, sf), fx.settlements(spark, sf))


_GRID = """
SELECT t.ticker, q.quarter, {value} FROM (SELECT DISTINCT ticker FROM weights) t
CROSS JOIN (SELECT DISTINCT quarter FROM weights) q
LEFT JOIN (SELECT ticker, quarter, avg(weight) AS weight FROM weights GROUP BY 1, 2) w
  ON w.ticker = t.ticker AND w.quarter = q.quarter"""


@query("J6_weight_grid", "weights", _GRID.format(value="round(coalesce(w.weight, 0), 4) AS weight"))
def j6(spark, sf):
    return rounded(index.weight_matrix(fx.composition(spark, sf)), "weight")


@query("A5_presence_matrix", "weights", _GRID.format(value="CAST(w.ticker IS NOT NULL AS INTEGER) AS present"))
def a5(spark, sf):
    return index.presence_matrix(fx.composition(spark, sf))


@query(
    "J7_spot_and_divisor",
    "spot divisor",
    """SELECT date, s.value, d.divisor
       FROM (SELECT * FROM spot WHERE date >= DATE '1998-06-30') s
       FULL JOIN (SELECT * FROM divisor WHERE date >= DATE '1998-06-30') d USING (date)""",
)
def j7(spark, sf):
    return index.spot_with_divisor(fx.spot(spark, sf), fx.divisor(spark, sf), "3Y", fx.AS_OF)


@query(
    "A3_total_market_cap",
    "composition",
    "SELECT date, round(sum(close * quantity), 2) AS total FROM composition GROUP BY date",
)
def a3(spark, sf):
    return rounded(index.total_market_cap(fx.composition(spark, sf)), "total", digits=2)


@query(
    "A4_quarterly_weight",
    "weights",
    "SELECT quarter, ticker, round(avg(weight), 4) AS weight FROM weights GROUP BY quarter, ticker",
)
def a4(spark, sf):
    return rounded(index.quarterly_weights(fx.composition(spark, sf)), "weight")


@query(
    "A6_dataset_summary",
    "composition spot dividends divisor",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS n_rows, {t} AS n_tickers, min(date) AS date_min, max(date) AS date_max FROM {n}"
        for n, t in [
            ("composition", "count(DISTINCT ticker)"),
            ("spot", "CAST(NULL AS BIGINT)"),
            ("dividends", "count(DISTINCT ticker)"),
            ("divisor", "CAST(NULL AS BIGINT)"),
        ]
    ),
)
def a6(spark, sf):
    return index.dataset_summary(
        {
            "composition": fx.composition(spark, sf),
            "spot": fx.spot(spark, sf),
            "dividends": fx.dividends(spark, sf),
            "divisor": fx.divisor(spark, sf),
        }
    )


@query("A7_unique_tickers", "composition projected current_comp", f"SELECT DISTINCT ticker FROM ({_SOURCES})")
def a7(spark, sf):
    chosen = ["historica", "proyectada", "vigente", "other"]
    return index.unique_tickers(sources(spark, sf), chosen)


@query(
    "A7_source_coverage",
    "composition projected current_comp",
    f"""SELECT source, min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS n_dates
        FROM ({_SOURCES}) GROUP BY source""",
)
def a7_coverage(spark, sf):
    return index.source_coverage(sources(spark, sf), ["historica", "proyectada", "vigente"])


@query(
    "A8_index_summary",
    "spot divisor",
    """SELECT min(date) AS date_min, max(date) AS date_max, count(*) AS n_days,
              min(value) AS value_min, max(value) AS value_max,
              (SELECT max_by(divisor, date) FROM divisor) AS current_divisor FROM spot""",
)
def a8(spark, sf):
    return index.index_summary(fx.spot(spark, sf), fx.divisor(spark, sf))


@query(
    "A17_weights_at_date",
    "composition",
    f"""SELECT date, ticker, quantity, close, source,
               round(close * quantity / sum(close * quantity) OVER () * 100, 2) AS weight
        FROM composition WHERE date = (SELECT max(date) FROM composition WHERE date <= DATE '{fx.TARGET}')""",
)
def a17(spark, sf):
    return index.weights_at(fx.composition(spark, sf), fx.TARGET)


@query(
    "X8_reconstructed_index",
    "composition spot divisor",
    """SELECT t.date, round(t.total, 2) AS total, d.divisor, round(t.total / d.divisor, 4) AS rebuilt,
              s.value, round(t.total / d.divisor - s.value, 4) AS difference
       FROM (SELECT date, sum(close * quantity) AS total FROM composition GROUP BY date) t
       ASOF JOIN divisor d ON t.date >= d.date LEFT JOIN spot s ON s.date = t.date""",
)
def x8(spark, sf):
    df = index.reconstructed_index(
        fx.composition(spark, sf), fx.divisor(spark, sf), fx.spot(spark, sf)
    )
    return rounded(rounded(df, "total", digits=2), "rebuilt", "difference")


# --- sorts, top rows, set operations


@query("O1_sorted_by_date", "composition", "SELECT date, ticker, quantity FROM composition")
def o1(spark, sf):
    # The ticker keeps the range sort able to cut a crowded date into several tasks.
    return fx.composition(spark, sf).select("date", "ticker", "quantity").orderBy("date", "ticker")


@query("O2_sorted_dimensions", "weights", "SELECT DISTINCT quarter FROM weights")
def o2(spark, sf):
    from marketlake.functions import quarter_label

    quarters = fx.trades(spark, sf).select(quarter_label(F.col("date")).alias("quarter"))
    return quarters.distinct().orderBy("quarter")


@query("O4_latest_row", "ohlcv", "SELECT ticker, max(date) AS date, max_by(close, date) AS close FROM ohlcv GROUP BY ticker")
def o4(spark, sf):
    return fx.bars(spark, sf).groupBy("ticker").agg(
        F.max("date").alias("date"), F.max_by("close", "date").alias("close")
    )


@query("U1_union_of_sources", "composition projected current_comp", _SOURCES)
def u1(spark, sf):
    parts = [df.select("source", "ticker", "date") for df in sources(spark, sf).values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("U2_distinct_dates", "composition", "SELECT DISTINCT date FROM composition")
def u2(spark, sf):
    return fx.composition(spark, sf).select("date").distinct()
