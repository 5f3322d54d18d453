"""Queries over model inputs, forecasts and their judgement."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import features, models, returns
from marketlake.plans.scratch import written
from suite import fixtures as fx
from suite.registry import query, rounded

WINDOW = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


@query(
    "X6_split_by_time",
    "ohlcv",
    """SELECT b.ticker, b.date, CASE WHEN d.rank <= floor(d.total * 0.7) THEN 'train'
                WHEN d.rank <= floor(d.total * 0.85) THEN 'validation' ELSE 'test' END AS part
       FROM ohlcv b JOIN (SELECT date, row_number() OVER (ORDER BY date) AS rank, count(*) OVER () AS total
                          FROM (SELECT DISTINCT date FROM ohlcv)) d ON d.date = b.date""",
)
def x6(spark, sf):
    return features.split_by_time(fx.bars(spark, sf)).select("ticker", "date", "part")


@query(
    "Y1_technical_features",
    "ohlcv",
    f"""SELECT ticker, date, round(CASE WHEN rn >= 20 THEN m END, 4) AS bb_middle,
               round(CASE WHEN rn >= 20 THEN m + 2 * s END, 4) AS bb_upper,
               round(CASE WHEN rn >= 20 THEN m - 2 * s END, 4) AS bb_lower,
               round(CASE WHEN rn >= 14 THEN avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING) END, 4) AS atr,
               round(CASE WHEN rn > 14 THEN 100 * sum(up) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)
                 / nullif(sum(up) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)
                        + sum(down) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), 0) END, 4) AS rsi
        FROM (SELECT ticker, date, row_number() OVER w AS rn,
                     avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS m,
                     stddev_pop(close) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS s,
                     greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0),
                              coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
                     greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down
              FROM ohlcv {WINDOW})""",
)
def y1(spark, sf):
    df = features.technical_features(fx.bars(spark, sf))
    names = ["bb_middle", "bb_upper", "bb_lower", "atr", "rsi"]
    return rounded(df.select("ticker", "date", *names), *names)


def _ema(value, span, rows):
    """Closed form of the recursive mean, good for series of moderate length."""
    keep = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"""(pow({keep}, n) * (sum({value} * CASE WHEN n = 0 THEN 1 ELSE 2.0::DOUBLE / {span + 1} END
                 * pow({keep}, -n)) OVER (PARTITION BY ticker ORDER BY date)))"""


@query(
    "Y2_macd",
    "ohlcv",
    f"""SELECT ticker, date, round(macd, 4) AS macd, round(signal, 4) AS macd_signal,
               round(macd - signal, 4) AS macd_hist
        FROM (SELECT *, {_ema("macd", 9, 0)} AS signal
              FROM (SELECT ticker, date, n, {_ema("close", 12, 0)} - {_ema("close", 26, 0)} AS macd
                    FROM (SELECT ticker, date, close, row_number() OVER w - 1 AS n FROM ohlcv {WINDOW})))""",
)
def y2(spark, sf):
    return rounded(features.macd(fx.bars(spark, sf)), "macd", "macd_signal", "macd_hist")


@query(
    "Y3_calendar_features",
    "ohlcv settlements",
    """SELECT b.ticker, b.date, CAST(isodow(b.date) - 1 AS INTEGER) AS day_of_week,
              CAST(b.date - d.last AS INTEGER) AS days_since_settlement,
              CAST(d.next - b.date AS INTEGER) AS days_to_settlement
       FROM ohlcv b JOIN (SELECT o.date, max(CASE WHEN s.date <= o.date THEN s.date END) AS last,
                                 min(CASE WHEN s.date >= o.date THEN s.date END) AS next
                          FROM (SELECT DISTINCT date FROM ohlcv) o CROSS JOIN settlements s GROUP BY o.date) d
         ON d.date = b.date""",
)
def y3(spark, sf):
    df = features.calendar_features(fx.bars(spark, sf), fx.settlements(spark, sf))
    return df.select("ticker", "date", "day_of_week", "days_since_settlement", "days_to_settlement")


_NAIVE = "".join(
    f"""{' UNION ALL ' if i else ''}SELECT ticker, date, {h} AS horizon, close AS actual, lag(close, {h}) OVER w AS forecast
        FROM ohlcv {WINDOW}"""
    for i, h in enumerate((1, 3, 5))
)


@query(
    "Y6_naive_forecast",
    "ohlcv",
    f"""SELECT ticker, date, horizon, actual, forecast
        FROM ({_NAIVE}) WHERE forecast IS NOT NULL""",
)
def y6(spark, sf):
    df = models.naive_forecasts(fx.bars(spark, sf))
    return df.select("ticker", "date", "horizon", "actual", "forecast")


def _drift(spark, sf):
    """Forecasts that carry the last change on, so that directions can be right or wrong."""
    b = fx.bars(spark, sf)
    last = F.lag("close").over(returns.by_date())
    return b.select(
        F.lit("drift").alias("model"),
        F.lit(1).alias("horizon"),
        F.col("close").alias("actual"),
        last.alias("previous"),
        (last + F.lag("close", 1).over(returns.by_date()) - F.lag("close", 2).over(returns.by_date())).alias("forecast"),
    ).filter(F.col("forecast").isNotNull())


@query(
    "Y4_forecast_metrics",
    "ohlcv",
    f"""SELECT model, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(sqrt(avg((forecast - actual) ** 2)), 4) AS rmse,
               round(avg(abs(forecast - actual)), 4) AS mae,
               round(avg(abs((forecast - actual) / actual)) * 100, 4) AS mape,
               round(avg(CAST(sign(forecast - previous) = sign(actual - previous) AS INTEGER)), 4) AS directional_accuracy
        FROM (SELECT 'naive' AS model, horizon, actual, forecast, forecast AS previous FROM ({_NAIVE})
              UNION ALL
              SELECT 'drift', 1, close, lag(close) OVER w + lag(close) OVER w - lag(close, 2) OVER w, lag(close) OVER w
              FROM ohlcv {WINDOW})
        WHERE forecast IS NOT NULL GROUP BY model, horizon""",
)
def y4(spark, sf):
    naive = models.naive_forecasts(fx.bars(spark, sf)).select(
        "model", "horizon", "actual", "previous", "forecast"
    )
    metrics = models.forecast_metrics(naive.unionByName(_drift(spark, sf)))
    return rounded(metrics, "rmse", "mae", "mape", "directional_accuracy")


@query(
    "Y5_strategy_metrics",
    "rets",
    f"""SELECT ticker, round(avg(gain) / nullif(stddev_samp(gain), 0) * sqrt(252), 4) AS sharpe,
               round(min(equity / greatest(peak, 1) - 1), 4) AS max_drawdown,
               round(max_by(equity, date), 4) AS final_equity
        FROM (SELECT *, max(equity) OVER w AS peak
              FROM (SELECT *, product(1 + gain) OVER w AS equity
                    FROM (SELECT ticker, date, coalesce(lag(signal) OVER w, 0) * coalesce(ret, 0) AS gain
                          FROM (SELECT ticker, date, greatest(least(ret / 10000, 0.01), -0.01) AS ret, CAST(sign(coalesce(ret, 0)) AS INTEGER) AS signal FROM rets)
                          {WINDOW}) {WINDOW}) {WINDOW})
        GROUP BY ticker""",
)
def y5(spark, sf):
    # The derived prices are random; returns of one percent at most keep the equity finite.
    signals = returns.daily_returns(fx.bars(spark, sf)).select(
        "ticker",
        "date",
        F.when(F.col("ret").isNotNull(), F.greatest(F.least(F.col("ret") / 10_000, F.lit(0.01)), F.lit(-0.01))).alias("ret"),
        F.signum(F.coalesce("ret", F.lit(0.0))).cast("int").alias("signal"),
    )
    metrics = models.strategy_metrics(signals)
    return rounded(metrics, "sharpe", "max_drawdown", "final_equity")


_CASES = """
WITH inputs AS (
  SELECT ticker, date, rsi, volatility, isodow(date) - 1 AS day, target,
         CASE WHEN d.rank <= floor(d.total * 0.7) THEN 'train' WHEN d.rank > floor(d.total * 0.85) THEN 'test' END AS part
  FROM (SELECT ticker, date, close, lead(close) OVER w / nullif(close, 0) - 1 AS target,
               CASE WHEN rn > 14 THEN 100 * sum(up) OVER (w ROWS 13 PRECEDING)
                 / nullif(sum(up) OVER (w ROWS 13 PRECEDING) + sum(down) OVER (w ROWS 13 PRECEDING), 0) END AS rsi,
               CASE WHEN rn > 20 THEN stddev_samp(ret) OVER (w ROWS 19 PRECEDING) * sqrt(252) * 100 END AS volatility
        FROM (SELECT ticker, date, close, row_number() OVER v AS rn, close / nullif(lag(close) OVER v, 0) - 1 AS ret,
                     greatest(close - lag(close) OVER v, 0) AS up, greatest(lag(close) OVER v - close, 0) AS down
              FROM ohlcv WINDOW v AS (PARTITION BY ticker ORDER BY date))
        WINDOW w AS (PARTITION BY ticker ORDER BY date)) b
  JOIN (SELECT date, row_number() OVER (ORDER BY date) AS rank, count(*) OVER () AS total
        FROM (SELECT DISTINCT date FROM ohlcv)) d USING (date)
  WHERE target IS NOT NULL
)"""

_LINE = """, train AS (SELECT rsi AS a, volatility AS b, target AS y FROM inputs WHERE part = 'train' AND rsi IS NOT NULL AND volatility IS NOT NULL),
m AS (
  SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(y) AS sy,
         covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS ab, covar_pop(a, y) / (stddev_pop(a) * stddev_pop(y)) AS ay,
         covar_pop(b, y) / (stddev_pop(b) * stddev_pop(y)) AS by_
  FROM train
),"""

_RIDGE = """fit AS (SELECT (1.1::DOUBLE * ay - ab * by_) / (1.1::DOUBLE * 1.1 - ab * ab) AS ba,
               (1.1::DOUBLE * by_ - ab * ay) / (1.1::DOUBLE * 1.1 - ab * ab) AS bb FROM m)"""

_LASSO = """steps AS (
  SELECT 0 AS i, 0::DOUBLE AS ba, 0::DOUBLE AS bb, ab, ay, by_ FROM m
  UNION ALL
  SELECT i + 1, na, sign(by_ - ab * na) * greatest(abs(by_ - ab * na) - 0.01, 0), ab, ay, by_
  FROM (SELECT *, sign(ay - ab * bb) * greatest(abs(ay - ab * bb) - 0.01, 0) AS na FROM steps WHERE i < 60)
),
fit AS (SELECT ba, bb FROM steps WHERE i = 60)"""

_SCORED_LINE = """, scored AS (
  SELECT target AS actual, my + ba * sy / sa * (rsi - ma) + bb * sy / sb * (volatility - mb) AS forecast
  FROM inputs, m, fit WHERE part = 'test' AND rsi IS NOT NULL AND volatility IS NOT NULL
)"""

# A tree of full depth predicts the mean of its group; a second round then finds residuals of mean 0.
_SCORED_TREE = """, fit AS (SELECT day, avg(target) AS forecast FROM inputs WHERE part = 'train' GROUP BY day),
scored AS (SELECT target AS actual, forecast FROM inputs JOIN fit USING (day) WHERE part = 'test')"""


def _judged(kind):
    return f"""
SELECT '{kind}' AS model, 1 AS horizon, count(*) AS n, round(sqrt(avg((forecast - actual) ** 2)), 4) AS rmse,
       round(avg(abs(forecast - actual)), 4) AS mae, round(avg(abs((forecast - actual) / nullif(actual, 0))) * 100, 4) AS mape,
       round(avg(CAST(sign(forecast) = sign(actual) AS INTEGER)), 4) AS directional_accuracy FROM scored"""


def _inlined(body):
    """With the names of a WITH list inside a subquery, as the market tables come before it."""
    return f"SELECT * FROM ({body})"


@query("Y7_ridge_forecast", "ohlcv", _inlined(_CASES + _LINE + _RIDGE + _SCORED_LINE + _judged("ridge")))
def y7(spark, sf):
    return _regression(spark, sf, "ridge", ["rsi", "volatility"])


@query("Y7_lasso_forecast", "ohlcv", _inlined(_CASES.replace("WITH", "WITH RECURSIVE", 1) + _LINE + _LASSO + _SCORED_LINE + _judged("lasso")))
def y7_lasso(spark, sf):
    return _regression(spark, sf, "lasso", ["rsi", "volatility"])


@query("Y7_random_forest_forecast", "ohlcv", _inlined(_CASES + _SCORED_TREE + _judged("random_forest")))
def y7_forest(spark, sf):
    """One tree of full depth over all rows, which must give the means of its groups."""
    whole = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 10}
    return _regression(spark, sf, "random_forest", ["day"], **whole)


@query("Y7_boosted_trees_forecast", "ohlcv", _inlined(_CASES + _SCORED_TREE + _judged("boosted_trees")))
def y7_boosted(spark, sf):
    """Two rounds of trees of full depth: the means of the groups, then those of the residuals."""
    return _regression(spark, sf, "boosted_trees", ["day"], maxIter=2, maxDepth=10)


def _regression(spark, sf, kind, names, **params):
    """Fitted on the training dates, judged on the test dates. A return is judged against 0, no change."""
    b = returns.forward_returns(returns.rolling_volatility(fx.bars(spark, sf)), (1,))
    rows = features.split_by_time(features.relative_strength(b)).withColumn("day", F.weekday("date"))
    rows = written(rows.select("part", "target_1", "rsi", "volatility", "day"), "inputs")
    model = models.fit_regressor(kind, rows.filter("part = 'train'"), names, "target_1", **params)
    scored = models.predict(model, rows.filter("part = 'test'").dropna(subset=["target_1"]), names)
    metrics = models.forecast_metrics(
        scored.select(
            F.lit(kind).alias("model"),
            F.lit(1).alias("horizon"),
            F.col("target_1").alias("actual"),
            F.lit(0.0).alias("previous"),
            F.col("prediction").alias("forecast"),
        )
    )
    return rounded(metrics, "rmse", "mae", "mape", "directional_accuracy")
