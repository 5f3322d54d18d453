"""Queries over coverage, gap alerts and their classification, and the scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake import functions as mf
from marketlake.operators import gaps, quality
from marketlake.plans.gap_report import gap_report, prepared_rows
from suite import fixtures as fx
from suite.registry import query


_MEMBERS = "(SELECT ticker, min(date) AS date FROM ohlcv GROUP BY ticker, month(date))"


@query(
    "A1_ticker_stats",
    "ohlcv",
    """SELECT ticker, n_rows, date_min, date_max, expected AS expected_bdays, expected - working AS missing_bdays
       FROM (SELECT ticker, count(*) AS n_rows, min(date) AS date_min, max(date) AS date_max,
                    len(list_filter(range(min(date), max(date) + INTERVAL 1 DAY, INTERVAL 1 DAY),
                                    lambda d: isodow(d) < 6)) AS expected,
                    count(DISTINCT CASE WHEN isodow(date) < 6 THEN date END) AS working
             FROM ohlcv GROUP BY ticker)""",
)
def a1(spark, sf):
    return quality.ticker_stats(fx.bars(spark, sf))


@query(
    "A2_coverage_matrix",
    "ohlcv",
    """SELECT ticker, CAST(year AS INTEGER) AS year,
              round_even(coalesce(n, 0) / coalesce(max(n) OVER (PARTITION BY year), 1) * 100, 1) AS coverage
       FROM (SELECT DISTINCT ticker FROM ohlcv) t CROSS JOIN (SELECT DISTINCT year(date) AS year FROM ohlcv) r
       LEFT JOIN (SELECT ticker, year(date) AS year, count(*) AS n FROM ohlcv GROUP BY 1, 2)
         USING (ticker, year)""",
)
def a2(spark, sf):
    return quality.coverage_matrix(fx.bars(spark, sf))


@query(
    "A9_bars_summary",
    "ohlcv",
    "SELECT count(DISTINCT ticker) AS n_tickers, min(date) AS date_min, max(date) AS date_max FROM ohlcv",
)
def a9(spark, sf):
    return quality.bars_summary(fx.bars(spark, sf))


@query(
    "A15_alert_totals",
    "alerts",
    f"""SELECT a.tipo, CASE WHEN p.ticker IS NULL THEN 'No' ELSE 'Sí' END AS en_indice, count(*) AS n
        FROM alerts a LEFT JOIN {_MEMBERS} p ON p.ticker = a.instrument AND p.date = a.date
        GROUP BY 1, 2""",
)
def a15(spark, sf):
    return gaps.alert_totals(gap_report(fx.bars(spark, sf), _members(spark, sf), unique=True))


def _members(spark, sf):
    """A composition that holds each ticker on its first day of every calendar month."""
    b = fx.bars(spark, sf)
    return b.groupBy("ticker", F.month("date")).agg(F.min("date").alias("date"))


@query(
    "A15_analysed_totals",
    "gaps",
    """SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_instruments, count(DISTINCT date) AS n_dates
       FROM gaps""",
)
def a15_analysed(spark, sf):
    return gaps.analysed_totals(prepared_rows(fx.bars(spark, sf), unique=True))


@query(
    "J4_index_membership",
    "alerts",
    f"""SELECT a.instrument, a.date, CASE WHEN p.ticker IS NULL THEN 'No' ELSE 'Sí' END AS en_indice
        FROM alerts a LEFT JOIN {_MEMBERS} p ON p.ticker = a.instrument AND p.date = a.date""",
)
def j4(spark, sf):
    alerts = gaps.detect_gaps(prepared_rows(fx.bars(spark, sf), unique=True))
    return gaps.flag_membership(alerts, _members(spark, sf)).select("instrument", "date", "en_indice")


@query(
    "D4_gap_report",
    "alerts",
    f"""SELECT a.instrument AS ticker, a.date_str AS fecha, a.tipo, a.variacion_pct, a.ratio_implicito,
               CASE WHEN p.ticker IS NULL THEN 'No' ELSE 'Sí' END AS en_indice
        FROM alerts a LEFT JOIN {_MEMBERS} p ON p.ticker = a.instrument AND p.date = a.date""",
)
def d4(spark, sf):
    return gaps.report(gap_report(fx.bars(spark, sf), _members(spark, sf), unique=True))


_RAW_SCAN = """(SELECT '  ' || lower(ticker) || ' ' AS ticker, date,
  CASE WHEN volume % 7 = 0 THEN NULL ELSE open END AS open,
  CASE WHEN volume % 11 = 0 THEN 0 WHEN volume % 13 = 0 THEN NULL WHEN volume % 17 = 0 THEN 'NaN'::DOUBLE
       ELSE close END AS close FROM ohlcv)"""


def _raw_scan(spark, sf):
    v = F.col("volume")
    close = (
        F.when(v % 11 == 0, 0.0)
        .when(v % 13 == 0, F.lit(None))
        .when(v % 17 == 0, F.lit(float("nan")))
        .otherwise(F.col("close"))
    )
    return fx.bars(spark, sf).select(
        F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")).alias("ticker"),
        "date",
        F.when(v % 7 != 0, F.col("open")).alias("open"),
        close.alias("close"),
    )


@query(
    "S10_scan_rows",
    "ohlcv",
    f"""SELECT upper(trim(ticker)) AS instrument, date, coalesce(open, close) AS open, close
        FROM {_RAW_SCAN} WHERE close <> 0 AND NOT isnan(close) AND coalesce(open, close) <> 0""",
)
def s10(spark, sf):
    return gaps.scan_rows(_raw_scan(spark, sf))


@query(
    "S14_membership_pairs",
    "composition",
    "SELECT DISTINCT ticker, date FROM composition",
)
def s14(spark, sf):
    lower = fx.composition(spark, sf).withColumn("ticker", F.concat(F.lower("ticker"), F.lit(" ")))
    return gaps.membership(lower)


@query(
    "U3_first_seen",
    "trades",
    """SELECT ticker AS instrument, date, min_by(px, row(px, l_quantity)) AS open,
              min_by(l_quantity, row(px, l_quantity)) AS close
       FROM trades GROUP BY ticker, date""",
)
def u3(spark, sf):
    # Every trade is offered as a candidate row, twice, so that most keys have copies.
    rows = fx.trades(spark, sf).select(
        F.col("ticker").alias("instrument"), "date", F.col("px").alias("open"), F.col("l_quantity").alias("close")
    )
    return gaps.first_seen([rows, rows])


@query(
    "X2_classified_alerts",
    "alerts splits macro dirty",
    """SELECT a.instrument, a.date,
              CASE WHEN s.ticker IS NOT NULL THEN 'confirmed_split' WHEN m.ticker IS NOT NULL THEN 'macro_event'
                   WHEN d.ticker IS NOT NULL THEN 'dirty_data' ELSE 'unexplained' END AS cause
       FROM alerts a LEFT JOIN splits s ON s.ticker = a.instrument AND s.date = a.date
       LEFT JOIN macro m ON m.ticker = a.instrument AND m.date = a.date
       LEFT JOIN dirty d ON d.ticker = a.instrument AND d.date = a.date""",
)
def x2(spark, sf):
    alerts = gaps.detect_gaps(prepared_rows(fx.bars(spark, sf), unique=True))
    lists = fx.splits(spark), fx.macro_events(spark), fx.dirty(spark, sf)
    return gaps.classify_alerts(alerts, *lists).select("instrument", "date", "cause")


@query(
    "X3_macro_dummies",
    "ohlcv macro",
    """SELECT b.ticker, b.date, CASE m.direction WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS macro_event
       FROM ohlcv b LEFT JOIN macro m ON m.ticker = b.ticker AND m.date = b.date""",
)
def x3(spark, sf):
    df = gaps.event_dummies(fx.bars(spark, sf), fx.macro_events(spark))
    return df.select("ticker", "date", "macro_event")


@query(
    "X7_business_calendar",
    "ohlcv",
    """SELECT g.ticker, g.date, b.close, b.date IS NULL AS missing
       FROM (SELECT ticker, CAST(unnest(range(min(date), max(date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date
             FROM ohlcv GROUP BY ticker) g
       LEFT JOIN ohlcv b ON b.ticker = g.ticker AND b.date = g.date WHERE isodow(g.date) < 6""",
)
def x7(spark, sf):
    return quality.align_to_calendar(fx.bars(spark, sf).select("ticker", "date", "close"))


# --- scalar function families


@query(
    "F_string_functions",
    "trades",
    """SELECT ticker, lower(ticker) || '_ohlcv' AS dataset, upper(regexp_replace(lower(ticker) || '_ohlcv', '_ohlcv$', '')) AS back,
              trim('  ' || ticker || ' ') AS trimmed, substring(ticker, 1, 1) AS head
       FROM (SELECT DISTINCT ticker FROM trades)""",
)
def f_string(spark, sf):
    dataset = F.concat(F.lower("ticker"), F.lit("_ohlcv"))
    return fx.trades(spark, sf).select("ticker").distinct().select(
        "ticker",
        dataset.alias("dataset"),
        F.upper(F.regexp_replace(dataset, "_ohlcv$", "")).alias("back"),
        F.trim(F.concat(F.lit("  "), "ticker", F.lit(" "))).alias("trimmed"),
        F.substring("ticker", 1, 1).alias("head"),
    )


@query(
    "F_number_text",
    "dividends",
    """SELECT ticker, date, amount, floor(amount * 1000 + 0.5) / 1000 AS from_comma,
              floor(amount * 1000 + 0.5) * 1000 AS from_spanish
       FROM dividends""",
)
def f_number_text(spark, sf):
    df = fx.dividends(spark, sf).select("ticker", "date", "amount")
    grouped = F.translate(F.format_number(F.col("amount") * 1_000_000, 2), ",.", ".,")
    return df.select(
        "ticker",
        "date",
        "amount",
        mf.decimal_comma(F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))).alias("from_comma"),
        mf.spanish_number(grouped).alias("from_spanish"),
    )


@query(
    "F_date_functions",
    "spot",
    """SELECT date, CAST(year(date) AS INTEGER) AS year, year(date) || '-Q' || quarter(date) AS quarter,
              strftime(date, '%d/%m/%Y') AS text, CAST(date - INTERVAL 3 MONTH AS DATE) AS three_months_before,
              CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
              len(list_filter(range(date, DATE '2001-12-31' + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6))
                AS bdays_left
       FROM spot""",
)
def f_date(spark, sf):
    text = F.date_format("date", "dd/MM/yyyy")
    return fx.spot(spark, sf).select(
        F.to_date(text, "d/M/yyyy").alias("date"),
        F.year("date").alias("year"),
        mf.quarter_label(F.col("date")).alias("quarter"),
        text.alias("text"),
        F.add_months("date", -3).alias("three_months_before"),
        F.weekday("date").alias("day_of_week"),
        mf.business_days(F.col("date"), F.lit("2001-12-31").cast("date")).alias("bdays_left"),
    )


@query(
    "F_math_functions",
    "rets",
    """SELECT ticker, date, round(abs(ret), 4) AS size, round(sqrt(abs(ret)), 4) AS root,
              round(exp(-ret * ret / 20000) / (100 * sqrt(2 * pi())), 8) AS density
       FROM rets WHERE ret IS NOT NULL""",
)
def f_math(spark, sf):
    from marketlake.operators.returns import return_pairs

    size = F.abs("ret")
    return return_pairs(fx.bars(spark, sf)).select(
        "ticker",
        "date",
        F.round(size, 4).alias("size"),
        F.round(F.sqrt(size), 4).alias("root"),
        F.round(mf.normal_density(F.col("ret"), F.lit(0.0), F.lit(100.0)), 8).alias("density"),
    )


@query(
    "F_null_functions",
    "ohlcv",
    f"""SELECT ticker, date, CASE WHEN isnan(close) THEN NULL ELSE close END IS NULL AS unknown,
               coalesce(CASE WHEN isnan(close) THEN NULL ELSE close END, 0) AS filled,
               round(open / nullif(CASE WHEN isnan(close) THEN NULL ELSE close END, 0), 4) AS share
        FROM {_RAW_SCAN} WHERE open IS NOT NULL OR (close IS NOT NULL AND NOT isnan(close))""",
)
def f_null(spark, sf):
    close = mf.without_nan(F.col("close"))
    return (
        _raw_scan(spark, sf)
        .dropna(how="all", subset=["open", "close"])
        .select(
            "ticker",
            "date",
            close.isNull().alias("unknown"),
            F.coalesce(close, F.lit(0.0)).alias("filled"),
            F.round(mf.ratio(F.col("open"), close), 4).alias("share"),
        )
    )


@query(
    "F_array_functions",
    "dirty",
    """SELECT ticker, date, low_ok AS low, high_ok AS high,
              value BETWEEN low_ok AND high_ok AS inside FROM dirty""",
)
def f_array(spark, sf):
    low, high = F.element_at("expected_range", 1), F.element_at("expected_range", 2)
    return fx.dirty(spark, sf).select(
        "ticker",
        "date",
        low.alias("low"),
        high.alias("high"),
        F.col("value").between(low, high).alias("inside"),
    )


@query(
    "F_json_functions",
    "",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_variant FROM events""",
)
def f_json(spark, sf):
    variant = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return fx.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), variant.alias("k_variant")
    )
