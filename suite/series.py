"""Queries over the bars of each ticker: ranges, returns, averages, distribution, adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import adjust, candles, gaps, returns, selection
from marketlake.plans.gap_report import prepared_rows
from marketlake.plans.scratch import scratch_path
from marketlake.sinks import load_bucketed, save_bucketed
from marketlake.sources.events import splits_of
from suite import fixtures as fx
from suite.registry import query, rounded

OHLC = ("open", "high", "low", "close")
RAW_OHLC = ", ".join(OHLC)
RANGE = f"date BETWEEN DATE '{fx.RANGE_FROM}' AND DATE '{fx.RANGE_TO}'"
WINDOW = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def ranged(spark, sf):
    return selection.date_range(fx.bars(spark, sf), fx.RANGE_FROM, fx.RANGE_TO)


def action_splits(spark, sf):
    return adjust.splits_from_actions(fx.dividends(spark, sf))


# --- projections, filters, predicates


@query("P1_canonical_bars", "ohlcv", f"SELECT date, {RAW_OHLC}, volume, ticker FROM ohlcv")
def p1(spark, sf):
    b = fx.bars(spark, sf)
    stamped = F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")).alias("d")
    records = b.select(
        stamped,
        *[F.col(c).alias(k) for c, k in zip((*OHLC, "volume"), "ohlcv"[:4] + "v")],
        "ticker",
    )
    return selection.canonical_bars(records)


@query(
    "P2_literal_tags",
    "ohlcv",
    "SELECT date, ticker, close, 'historica' AS source, false AS split_adjusted FROM ohlcv",
)
def p2(spark, sf):
    df = fx.bars(spark, sf).select("date", "ticker", "close")
    return selection.tagged(df, source="historica", split_adjusted=False)


@query(
    "P3_conditional_rewrite",
    "ohlcv",
    "SELECT date, ticker, CASE WHEN date < DATE '1998-08-05' THEN volume * 2 ELSE volume END AS volume FROM ohlcv",
)
def p3(spark, sf):
    before = F.col("date") < F.lit("1998-08-05").cast("date")
    df = fx.bars(spark, sf).select("date", "ticker", "volume")
    return selection.rewritten(df, "volume", before, F.col("volume") * 2)


@query("P4_date_range", "ohlcv", f"SELECT date, {RAW_OHLC}, volume, ticker FROM ohlcv WHERE {RANGE}")
def p4(spark, sf):
    return ranged(spark, sf)


@query(
    "P5_trailing_range_from_a_day",
    "ohlcv",
    f"""SELECT p AS period, ticker, date, close FROM ohlcv, (VALUES ('MAX', DATE '{fx.RANGE_FROM}'), ('all', DATE '{fx.RANGE_FROM}'),
          ('1Y', DATE '2000-06-30')) AS v(p, d) WHERE date >= d""",
)
def p5_start(spark, sf):
    """MAX and an unknown label begin at a fixed day; the others as ever."""
    b, out = fx.bars(spark, sf).select("ticker", "date", "close"), None
    for p in ("MAX", "all", "1Y"):
        part = selection.trailing_range(b, p, fx.AS_OF, max_start=fx.RANGE_FROM).withColumn("period", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "P5_trailing_range",
    "ohlcv",
    " UNION ALL ".join(
        f"SELECT '{p}' AS period, ticker, date, close FROM ohlcv WHERE date >= DATE '{d}'"
        for p, d in [
            ("3M", "2001-03-30"),
            ("6M", "2000-12-30"),
            ("1Y", "2000-06-30"),
            ("3Y", "1998-06-30"),
            ("MAX", "0001-01-01"),
        ]
    ),
)
def p5(spark, sf):
    b = fx.bars(spark, sf).select("ticker", "date", "close")
    parts = [
        selection.trailing_range(b, p, fx.AS_OF).withColumn("period", F.lit(p))
        for p in ("3M", "6M", "1Y", "3Y", "MAX")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("P6_ticker_filter", "ohlcv", f"SELECT date, {RAW_OHLC}, volume, ticker FROM ohlcv WHERE ticker = 'S7'")
def p6(spark, sf):
    return selection.for_ticker(fx.bars(spark, sf), "s7")


_SPOILT = """(SELECT CASE WHEN volume % 13 = 0 THEN NULL ELSE ticker END AS ticker, date,
  CASE WHEN volume % 7 = 0 THEN NULL WHEN volume % 5 = 0 THEN 0 ELSE open END AS open, close FROM ohlcv)"""


def spoilt(spark, sf):
    v = F.col("volume")
    return fx.bars(spark, sf).select(
        F.when(v % 13 != 0, F.col("ticker")).alias("ticker"),
        "date",
        F.when(v % 7 != 0, F.when(v % 5 == 0, 0.0).otherwise(F.col("open"))).alias("open"),
        "close",
    )


@query(
    "P7_usable_prices",
    "ohlcv",
    f"""SELECT ticker, date, open, close FROM {_SPOILT}
        WHERE ticker IS NOT NULL AND open <> 0 AND close <> 0""",
)
def p7(spark, sf):
    df = spoilt(spark, sf)
    return df.filter(selection.usable_price(df))


@query(
    "P7_rejected_prices",
    "ohlcv",
    f"""SELECT ticker, date, open, close,
               CASE WHEN ticker IS NULL THEN 'missing key' WHEN open IS NULL THEN 'missing price'
                    ELSE 'zero price' END AS reason
        FROM {_SPOILT} WHERE ticker IS NULL OR open IS NULL OR open = 0""",
)
def p7_rejected(spark, sf):
    return selection.rejected_prices(spoilt(spark, sf))


_FACTORS = """
SELECT b.date, b.ticker, b.open, b.high, b.low, b.close, b.volume,
       coalesce(product(s.ratio), 1) AS ratio
FROM ohlcv b LEFT JOIN {splits} s ON s.ticker = b.ticker AND b.date < s.date
GROUP BY b.date, b.ticker, b.open, b.high, b.low, b.close, b.volume"""


@query(
    "P8_index_only_splits",
    "ohlcv splits",
    f"""SELECT date, ticker, round(close * (1 / ratio), 8) AS close,
               ticker IN (SELECT ticker FROM splits WHERE in_index) AS split_adjusted
        FROM ({_FACTORS.format(splits="(SELECT * FROM splits WHERE in_index)")})""",
)
def p8(spark, sf):
    df = adjust.adjust_prices(fx.bars(spark, sf), fx.splits(spark), index_only=True)
    return rounded(df.select("date", "ticker", "close", "split_adjusted"), "close", digits=8)


@query(
    "P9_minimum_history",
    "ohlcv",
    f"""SELECT date, ticker, close FROM
        (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM ohlcv WHERE {RANGE}) WHERE n >= 10""",
)
def p9(spark, sf):
    kept = selection.with_history(ranged(spark, sf), 10)
    return kept.select("date", "ticker", "close")


@query("P10_up_day", "ohlcv", "SELECT date, ticker, close >= open AS up FROM ohlcv")
def p10(spark, sf):
    return selection.day_flags(fx.bars(spark, sf)).select("date", "ticker", "up")


@query("P10_return_sign", "rets", "SELECT date, ticker, ret >= 0 AS gain FROM rets WHERE ret IS NOT NULL")
def p10_sign(spark, sf):
    pairs = returns.return_pairs(fx.bars(spark, sf))
    return returns.sign_flags(pairs).select("date", "ticker", "gain")


@query(
    "P11_instrument_codes",
    "trades",
    "SELECT DISTINCT ticker, 'bm_MERV_' || ticker || '_24hs' AS instrument, ticker AS ticker_back FROM trades",
)
def p11(spark, sf):
    return selection.instrument_codes(fx.trades(spark, sf).select("ticker").distinct())


# --- windows


@query("W1_daily_return", "rets", "SELECT ticker, date, round(ret, 4) AS ret FROM rets")
def w1(spark, sf):
    return rounded(returns.daily_returns(fx.bars(spark, sf)).select("ticker", "date", "ret"), "ret")


@query(
    "W1_return_in_range",
    "ohlcv",
    f"""SELECT ticker, date, round(ret, 4) AS ret FROM (
          SELECT ticker, date, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS ret
          FROM ohlcv WHERE {RANGE} {WINDOW}) WHERE ret IS NOT NULL""",
)
def w1_range(spark, sf):
    return rounded(returns.return_pairs(ranged(spark, sf)), "ret")


@query(
    "W2_fractional_return",
    "ohlcv",
    f"SELECT ticker, date, round(close / nullif(lag(close) OVER w, 0) - 1, 6) AS ret FROM ohlcv {WINDOW}",
)
def w2(spark, sf):
    df = returns.daily_returns(fx.bars(spark, sf), percent=False)
    return rounded(df.select("ticker", "date", "ret"), "ret", digits=6)


def _sma(n):
    return (
        f"round(CASE WHEN row_number() OVER w >= {n} THEN avg(close) OVER "
        f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) END, 4) AS sma{n}"
    )


@query("W3_moving_average", "ohlcv", f"SELECT ticker, date, {_sma(20)}, {_sma(50)} FROM ohlcv {WINDOW}")
def w3(spark, sf):
    df = candles.moving_averages(fx.bars(spark, sf))
    return rounded(df.select("ticker", "date", "sma20", "sma50"), "sma20", "sma50")


_VOL = """
SELECT ticker, date, CASE WHEN rn > 20 AND count(ret) OVER f >= 2
       THEN stddev_samp(ret) OVER f * sqrt(252) * 100 END AS volatility
FROM (SELECT ticker, date, ret / 100 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn
      FROM rets)
WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)"""


@query("W4_rolling_volatility", "rets", f"SELECT ticker, date, round(volatility, 4) AS volatility FROM ({_VOL})")
def w4(spark, sf):
    df = returns.rolling_volatility(fx.bars(spark, sf), 20)
    return rounded(df.select("ticker", "date", "volatility"), "volatility")


@query(
    "A18_mean_volatility",
    "rets",
    f"""SELECT ticker, round(coalesce(avg(volatility), 0), 4) AS mean_volatility
        FROM ({_VOL}) GROUP BY ticker""",
)
def a18(spark, sf):
    vol = returns.rolling_volatility(fx.bars(spark, sf), 20)
    return rounded(returns.mean_volatility(vol), "mean_volatility")


_ALERT = """instrument, date, date_str, tipo, variacion_pct, ratio_implicito,
  prev_close, open AS open_next"""


@query("W5_overnight_gap", "alerts", f"SELECT {_ALERT} FROM alerts")
def w5(spark, sf):
    return gaps.detect_gaps(prepared_rows(fx.bars(spark, sf), unique=True))


_STEPS = range(-3, 4)
_NAMES = {k: f"m{-k}" if k < 0 else f"p{k}" for k in _STEPS}


def _offset(column, k):
    return f"lag({column}, {-k}) OVER w" if k < 0 else f"lead({column}, {k}) OVER w"


_AROUND = ", ".join(
    f"strftime({_offset('date', k)}, '%d/%m/%Y') AS fecha_{n}, {_offset('open', k)} AS open_{n}, {_offset('close', k)} AS close_{n}, "
    f"round_even({_offset('(close - prev_close) / prev_close * 100', k)}, 2) + 0.0::DOUBLE AS var_{n}"  # no -0.0
    for k, n in _NAMES.items()
)


@query(
    "W6_gap_context",
    "alerts",
    f"""SELECT * EXCLUDE (gap), least(rn, 4) AS pos FROM (
          SELECT instrument, date, gap, rn, {_AROUND}, least(rn - 1, 3) + 1 + least(n - rn, 3) AS n_context
          FROM gaps WINDOW w AS (PARTITION BY instrument ORDER BY date))
        WHERE abs(gap) > 30""".replace("EXCLUDE (gap)", "EXCLUDE (gap, rn)"),
)
def w6(spark, sf):
    """One row per alert: how many rows its context has, the place of the event in it, and each of them in columns."""
    alerts = gaps.detect_gaps_with_context(prepared_rows(fx.bars(spark, sf), unique=True))
    place = F.array_position(F.transform("context", lambda r: r["is_event"]), True)
    placed = alerts.select("instrument", "date", "context", place.alias("pos"))
    cells = [
        F.when(F.col("pos") + k > 0, F.get("context", (F.col("pos") + k - 1).cast("int")))[c].alias(f"{n}_{_NAMES[k]}")
        for k in _STEPS
        for c, n in (("fecha", "fecha"), ("open", "open"), ("close", "close"), ("var_dia_pct", "var"))
    ]
    return placed.select("instrument", "date", "pos", F.size("context").cast("long").alias("n_context"), *cells)


@query(
    "W7_cumulative_return",
    "ohlcv",
    f"""SELECT ticker, date, round((product(step) OVER w - 1) * 100, 4) AS cumulative FROM (
          SELECT ticker, date, coalesce(close / nullif(lag(close) OVER w, 0), 1) AS step FROM ohlcv {WINDOW})
        {WINDOW}""",
)
def w7(spark, sf):
    df = returns.cumulative_return(fx.bars(spark, sf))
    return rounded(df.select("ticker", "date", "cumulative"), "cumulative")


@query(
    "W8_rebased",
    "ohlcv",
    f"""SELECT ticker, date, round(close / coalesce(nullif(first(close) OVER w, 0), 1) * 100, 4) AS rebased
        FROM ohlcv {WINDOW}""",
)
def w8(spark, sf):
    df = returns.rebased(fx.bars(spark, sf))
    return rounded(df.select("ticker", "date", "rebased"), "rebased")


@query(
    "W9_cumulative_split_factor",
    "action_days",
    """SELECT ticker, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS valid_from, date AS valid_to,
              round(ln(product(ratio) OVER (PARTITION BY ticker ORDER BY date DESC)), 6) AS log_ratio
       FROM action_days""",
)
def w9(spark, sf):
    intervals = adjust.split_intervals(action_splits(spark, sf))
    return intervals.select(
        "ticker", "valid_from", "valid_to", F.round(F.ln("ratio"), 6).alias("log_ratio")
    )


# --- split adjustment


@query(
    "J2_split_interval_join",
    "ohlcv splits",
    f"SELECT date, ticker, round(ratio, 6) AS split_ratio FROM ({_FACTORS.format(splits='splits')})",
)
def j2(spark, sf):
    intervals = adjust.split_intervals(fx.splits(spark))
    df = adjust.factors_by_interval(fx.bars(spark, sf), intervals)
    return rounded(df.select("date", "ticker", "split_ratio"), "split_ratio", digits=6)


@query(
    "J2_split_ladder",
    "ohlcv action_days",
    """SELECT b.date, b.ticker, round(ln(coalesce(product(s.ratio), 1)), 6) AS log_ratio
       FROM ohlcv b LEFT JOIN action_days s ON s.ticker = b.ticker AND b.date < s.date
       GROUP BY b.date, b.ticker""",
)
def j2_ladder(spark, sf):
    intervals = adjust.split_intervals(action_splits(spark, sf))
    df = adjust.factors_by_ladder(fx.bars(spark, sf), intervals)
    return df.select("date", "ticker", F.round(F.ln("split_ratio"), 6).alias("log_ratio"))


@query(
    "J2_split_merge",
    "ohlcv action_days",
    """SELECT b.date, b.ticker, round(ln(coalesce(product(s.ratio), 1)), 6) AS log_ratio
       FROM ohlcv b LEFT JOIN action_days s ON s.ticker = b.ticker AND b.date < s.date
       GROUP BY b.date, b.ticker""",
)
def j2_merge(spark, sf):
    intervals = adjust.split_intervals(action_splits(spark, sf))
    df = adjust.factors_by_merge(fx.bars(spark, sf), intervals)
    return df.select("date", "ticker", F.round(F.ln("split_ratio"), 6).alias("log_ratio"))


_ADJUSTED = ", ".join(f"round({c} * (1 / ratio), 8) AS {c}" for c in OHLC)


@query(
    "D1_adjust_index_splits",
    "ohlcv splits",
    f"""SELECT date, ticker, {_ADJUSTED}, volume,
               ticker IN (SELECT ticker FROM splits WHERE in_index) AS split_adjusted
        FROM ({_FACTORS.format(splits="(SELECT * FROM splits WHERE in_index)")})""",
)
def d1(spark, sf):
    return rounded(adjust.adjust_prices(fx.bars(spark, sf), fx.splits(spark)), *OHLC, digits=8)


@query(
    "D2_adjust_all_counts",
    "trades splits",
    """SELECT count(*) FILTER (touched) AS adjusted, count(*) FILTER (NOT touched) AS unchanged FROM (
         SELECT DISTINCT ticker, ticker IN (SELECT ticker FROM splits WHERE in_index) AS touched FROM trades)""",
)
def d2(spark, sf):
    return adjust.adjusted_counts(adjust.adjust_prices(fx.bars(spark, sf), fx.splits(spark)))


ALL_ADJUSTED = f"""SELECT date, ticker, {_ADJUSTED}, round(volume * ratio, 8) AS volume
        FROM ({_FACTORS.format(splits="splits")})"""


@query("D3_adjust_all_splits_and_volume", "ohlcv splits", ALL_ADJUSTED)
def d3(spark, sf):
    df = adjust.adjust_prices(
        fx.bars(spark, sf), fx.splits(spark), index_only=False, volume_mode="multiply"
    )
    return rounded(df.drop("split_adjusted"), *OHLC, "volume", digits=8)


@query(
    "flagship_adjusted_gaps",
    "ohlcv splits",
    f"""SELECT ticker, count(*) AS n_alerts, round(max(abs(gap)), 4) AS largest FROM (
          SELECT ticker, (open - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS gap FROM (
            SELECT date, ticker, open * (1 / ratio) AS open, close * (1 / ratio) AS close
            FROM ({_FACTORS.format(splits="(SELECT * FROM splits WHERE in_index)")}))
          {WINDOW}) WHERE abs(gap) > 30 GROUP BY ticker""",
)
def flagship(spark, sf):
    adjusted = adjust.adjust_prices(fx.bars(spark, sf), fx.splits(spark), canonical=True)
    rows = prepared_rows(adjusted, unique=True)
    jumps = gaps.overnight_gaps(rows).filter(F.abs("gap") > gaps.THRESHOLD)
    found = jumps.groupBy(F.col("instrument").alias("ticker")).agg(
        F.count(F.lit(1)).alias("n_alerts"), F.max(F.abs("gap")).alias("largest")
    )
    return rounded(found, "largest")


# --- on stored bars


def stored(spark, sf):
    """The bars, stored once in buckets of tickers."""
    root = scratch_path(spark, "bucketed")
    save_bucketed(fx.bars(spark, sf), root, "raw", "ohlcv", buckets=8)
    return load_bucketed(spark, root, "raw", "ohlcv")


def _range_of_closes(bars):
    return rounded(candles.moving_averages(bars).select("ticker", "date", "sma20", "sma50"), "sma20", "sma50")


#: What works ticker by ticker, as functions of the bars; the benchmark times them on stored ones.
BY_TICKER = {
    "W1_daily_return": returns.daily_returns,
    "W3_moving_average": _range_of_closes,
    "W4_rolling_volatility": lambda b: returns.rolling_volatility(b, 20),
    "W5_overnight_gap": lambda b: gaps.detect_gaps(prepared_rows(b, unique=True)),
    "W6_gap_context": lambda b: gaps.detect_gaps_with_context(prepared_rows(b, unique=True)),
    "W7_cumulative_return": returns.cumulative_return,
    "D1_adjust_index_splits": lambda b: adjust.adjust_prices(b, fx.splits(b.sparkSession), canonical=True),
}


@query("K1_bucketed_bars", "ohlcv", f"SELECT date, {RAW_OHLC}, volume, ticker FROM ohlcv")
def k1_bucketed(spark, sf):
    return stored(spark, sf)


@query("W5_gap_of_bucketed_bars", "alerts", f"SELECT {_ALERT} FROM alerts")
def w5_bucketed(spark, sf):
    return BY_TICKER["W5_overnight_gap"](stored(spark, sf))


@query("W3_average_of_bucketed_bars", "ohlcv", f"SELECT ticker, date, {_sma(20)}, {_sma(50)} FROM ohlcv {WINDOW}")
def w3_bucketed(spark, sf):
    return BY_TICKER["W3_moving_average"](stored(spark, sf))


@query(
    "D5_candlestick",
    "ohlcv",
    f"""SELECT date, {RAW_OHLC}, volume, ticker, {_sma(20)}, {_sma(50)}, close >= open AS up
        FROM ohlcv WHERE {RANGE} {WINDOW}""",
)
def d5(spark, sf):
    df = candles.candlestick(fx.bars(spark, sf), fx.RANGE_FROM, fx.RANGE_TO)
    return rounded(df, "sma20", "sma50")


@query(
    "D6_ticker_comparison",
    "ohlcv",
    f"""SELECT 'base100' AS mode, ticker, date,
               round(close / coalesce(nullif(first(close) OVER w, 0), 1) * 100, 4) AS value
        FROM ohlcv {WINDOW}
        UNION ALL
        SELECT 'cumulative', ticker, date, round((product(step) OVER w - 1) * 100, 4) FROM (
          SELECT ticker, date, coalesce(close / nullif(lag(close) OVER w, 0), 1) AS step FROM ohlcv {WINDOW})
        {WINDOW}""",
)
def d6(spark, sf):
    b = fx.bars(spark, sf)
    parts = [returns.comparison(b, m).withColumn("mode", F.lit(m)) for m in ("base100", "cumulative")]
    return rounded(parts[0].unionByName(parts[1]), "value")


# --- statistics of returns

_MOMENTS = """
SELECT ticker, count(ret) AS n, avg(ret) AS mean, stddev_pop(ret) AS std_pop, stddev_samp(ret) AS std_samp,
       skewness(ret) AS skew, kurtosis(ret) AS kurtosis
FROM rets WHERE ret IS NOT NULL GROUP BY ticker"""


@query(
    "A10_return_moments",
    "rets",
    f"""SELECT ticker, n, round(mean, 4) AS mean, round(std_pop, 4) AS std_pop, round(std_samp, 4) AS std_samp,
               round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis FROM ({_MOMENTS})""",
)
def a10(spark, sf):
    df = returns.return_moments(returns.return_pairs(fx.bars(spark, sf)))
    return rounded(df, "mean", "std_pop", "std_samp", "skew", "kurtosis")


@query(
    "A11_tail_flags",
    "rets",
    f"SELECT ticker, abs(skew) > 1 AS skewed, kurtosis > 3 AS heavy_tails FROM ({_MOMENTS})",
)
def a11(spark, sf):
    moments = returns.return_moments(returns.return_pairs(fx.bars(spark, sf)))
    return returns.tail_flags(moments).select("ticker", "skewed", "heavy_tails")


@query(
    "A12_return_distribution",
    "rets",
    """SELECT ticker, round(quantile_cont(ret, 0.25), 4) AS q1, round(quantile_cont(ret, 0.5), 4) AS median,
              round(quantile_cont(ret, 0.75), 4) AS q3, round(stddev_samp(ret), 4) AS std,
              round(min(ret), 4) AS min, round(max(ret), 4) AS max
       FROM rets WHERE ret IS NOT NULL GROUP BY ticker""",
)
def a12(spark, sf):
    df = returns.distribution(returns.return_pairs(fx.bars(spark, sf)))
    return rounded(df, "q1", "median", "q3", "std", "min", "max")


@query(
    "A13_histogram",
    "rets",
    """SELECT ticker, CAST(bin AS INTEGER) AS bin, round(low + bin * width, 4) AS bin_start, count(*) AS n,
              round(count(*) / (total * width), 6) AS density
       FROM (SELECT *, least(coalesce(floor((ret - low) / nullif(width, 0)), 0), 49) AS bin
             FROM (SELECT ticker, ret, min(ret) OVER t AS low,
                          (max(ret) OVER t - min(ret) OVER t) / 50 AS width, count(*) OVER t AS total
                   FROM rets WHERE ret IS NOT NULL WINDOW t AS (PARTITION BY ticker)))
       GROUP BY ticker, bin, low, width, total""",
)
def a13(spark, sf):
    df = returns.histogram(returns.return_pairs(fx.bars(spark, sf)))
    return rounded(rounded(df, "bin_start"), "density", digits=6)


@query(
    "A14_normal_curve",
    "rets",
    """SELECT ticker, CAST(point AS INTEGER) AS point, round(low + point * step, 4) AS x,
              round(exp(-pow((low + point * step - mean) / std, 2) / 2) / (std * sqrt(2 * pi())), 8) AS density
       FROM (SELECT ticker, avg(ret) AS mean, stddev_samp(ret) AS std, min(ret) AS low,
                    (max(ret) - min(ret)) / 299 AS step
             FROM rets WHERE ret IS NOT NULL GROUP BY ticker), range(300) AS r(point)""",
)
def a14(spark, sf):
    df = returns.normal_curve(returns.return_pairs(fx.bars(spark, sf)))
    return rounded(rounded(df, "x"), "density", digits=8)


@query(
    "J5_aligned_returns",
    "rets",
    """SELECT ticker, date, round(ret, 4) AS ret FROM rets
       WHERE ret IS NOT NULL AND ticker IN (SELECT ticker FROM ohlcv GROUP BY ticker HAVING count(*) >= 10)""",
)
def j5(spark, sf):
    return rounded(returns.aligned_returns(fx.bars(spark, sf)), "ret")


_WIDE = ["S1", "S2", "S7"]


@query(
    "J5_wide_returns",
    "rets",
    "SELECT date, "
    + ", ".join(f"round(max(ret) FILTER (ticker = '{t}'), 4) AS {t}" for t in _WIDE)
    + f""" FROM rets WHERE ret IS NOT NULL AND ticker IN ({", ".join(f"'{t}'" for t in _WIDE)}) GROUP BY date""",
)
def j5_wide(spark, sf):
    return rounded(returns.wide_returns(fx.bars(spark, sf), _WIDE), *_WIDE)


@query(
    "X5_forward_targets",
    "ohlcv",
    "SELECT ticker, date, "
    + ", ".join(
        f"round(lead(close, {h}) OVER w / nullif(close, 0) - 1, 6) AS target_{h}" for h in (1, 3, 5)
    )
    + f" FROM ohlcv {WINDOW}",
)
def x5(spark, sf):
    df = returns.forward_returns(fx.bars(spark, sf))
    names = ["target_1", "target_3", "target_5"]
    return rounded(df.select("ticker", "date", *names), *names, digits=6)


# --- corporate actions


@query("X1_classify_actions", "actions", "SELECT ticker, date, amount, type, kind, ratio FROM actions")
def x1(spark, sf):
    return adjust.classify_actions(fx.dividends(spark, sf)).select(
        "ticker", "date", "amount", "type", "kind", "ratio"
    )


@query(
    "X1_splits_from_actions",
    "actions",
    """SELECT ticker, date, ratio, false AS in_index, false AS verified, 'ac_split' AS notes
       FROM actions WHERE kind = 'ac_split'""",
)
def x1_splits(spark, sf):
    return action_splits(spark, sf)


@query("S13_splits_of_ticker", "actions", "SELECT date, ratio FROM actions WHERE kind = 'ac_split' AND ticker = 'S1'")
def s13(spark, sf):
    return splits_of(action_splits(spark, sf), "s1").select("date", "ratio")


@query("O3_splits_newest_first", "actions", "SELECT ticker, date, ratio FROM actions WHERE kind = 'ac_split'")
def o3(spark, sf):
    return action_splits(spark, sf).select("ticker", "date", "ratio").orderBy(F.desc("date"), "ticker", "ratio")


@query(
    "X4_null_dirty_values",
    "ohlcv dirty",
    """SELECT b.ticker, b.date, CASE WHEN d.field IS NULL THEN b.open END AS open,
              b.close, d.field IS NOT NULL AS patched
       FROM ohlcv b LEFT JOIN dirty d ON d.ticker = b.ticker AND d.date = b.date""",
)
def x4(spark, sf):
    df = adjust.null_dirty_values(fx.bars(spark, sf), fx.dirty(spark, sf))
    return df.select("ticker", "date", "open", "close", F.col("dirty_fields").isNotNull().alias("patched"))


@query(
    "X4_range_check",
    "dirty",
    """SELECT ticker, date, field, value AS stored, value < low_ok OR value > high_ok AS out_of_range
       FROM dirty""",
)
def x4_range(spark, sf):
    return adjust.out_of_range(fx.bars(spark, sf), fx.dirty(spark, sf))
