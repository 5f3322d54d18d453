import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from marketlake.operators import features, models
from tests.conftest import day

CLOSES = [10.0, 11.0, 10.5, 12.0, 11.0, 13.0, 12.5, 12.0, 14.0, 13.5, 15.0, 14.0, 16.0, 15.5, 17.0, 16.0]


def test_macd_equals_a_recursive_loop(make_series):
    def ema(values, span):
        out = [values[0]]
        for v in values[1:]:
            out.append(out[-1] + 2 / (span + 1) * (v - out[-1]))
        return np.array(out)

    line = ema(CLOSES, 12) - ema(CLOSES, 26)
    signal = ema(list(line), 9)
    got = features.macd(make_series(CLOSES)).orderBy("date").toPandas()
    np.testing.assert_allclose(got["macd"], line)
    np.testing.assert_allclose(got["macd_signal"], signal)
    np.testing.assert_allclose(got["macd_hist"], line - signal)


def test_relative_strength(make_series, series):
    rsi = series(features.relative_strength(make_series(CLOSES)), "rsi")
    changes = np.diff(CLOSES)[:14]
    up, down = changes[changes > 0].sum(), -changes[changes < 0].sum()
    assert rsi[13] is None and rsi[14] == pytest.approx(100 * up / (up + down))
    assert series(features.relative_strength(make_series([5.0] * 16)), "rsi")[15] is None


def test_bollinger_and_true_range(make_bars, make_series, series):
    bands = features.bollinger(make_series(CLOSES), n=4).orderBy("date").collect()
    assert bands[2].bb_upper is None
    assert bands[3].bb_upper == pytest.approx(np.mean(CLOSES[:4]) + 2 * np.std(CLOSES[:4]))
    bars = make_bars([("A", "2024-01-01", 10.0, 12.0), ("A", "2024-01-02", 20.0, 19.0)])
    assert series(features.true_range(bars), "true_range") == [2.0, 8.0]


def test_calendar_features(spark, make_series):
    settled = spark.createDataFrame([(day("2024-01-02"),), (day("2024-01-05"),)], "date date")
    got = features.calendar_features(make_series([1.0] * 6), settled).orderBy("date").collect()
    assert [r.days_since_settlement for r in got] == [None, 0, 1, 2, 0, 1]
    assert [r.days_to_settlement for r in got] == [1, 0, 2, 1, 0, None]
    assert got[0].day_of_week == 0


def test_naive_forecast_and_metrics(make_series):
    forecasts = models.naive_forecasts(make_series(CLOSES), (1, 3))
    by = {r.horizon: r for r in models.forecast_metrics(forecasts).collect()}
    errors = np.diff(CLOSES)
    assert by[1].n == len(CLOSES) - 1 and by[3].n == len(CLOSES) - 3
    assert by[1].rmse == pytest.approx(math.sqrt((errors**2).mean()))
    assert by[1].mae == pytest.approx(np.abs(errors).mean())
    assert by[1].mape == pytest.approx((np.abs(errors) / CLOSES[1:]).mean() * 100)
    assert by[1].directional_accuracy == pytest.approx((errors == 0).mean())


def test_strategy(spark):
    rows = [(0.1, 1), (0.2, -1), (0.5, 1), (-0.5, 0), (0.3, 0)]
    data = [("A", day(f"2024-01-{i + 1:02d}"), r, s) for i, (r, s) in enumerate(rows)]
    signals = spark.createDataFrame(data, "ticker string, date date, ret double, signal int")
    gains = np.array([0.0, 0.2, -0.5, -0.5, 0.0])
    equity = np.cumprod(1 + gains)
    row = models.strategy_metrics(signals).first()
    assert row.final_equity == pytest.approx(equity[-1])
    assert row.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())
    assert row.sharpe == pytest.approx(gains.mean() / gains.std(ddof=1) * math.sqrt(252))


@pytest.mark.parametrize("kind", list(models.REGRESSORS))
def test_regressors_learn_a_line(spark, kind):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(100.0), "y": 3 * np.arange(100.0) + 1}))
    with_gap = df.unionByName(spark.range(1).select(F.lit(None).cast("double").alias("x"), F.lit(1.0).alias("y")))
    model = models.fit_regressor(kind, with_gap, ["x"], "y")
    scored = models.predict(model, with_gap, ["x"]).toPandas()
    assert len(scored) == 100
    assert np.abs(scored["prediction"] - scored["y"]).mean() < 30


def test_unknown_regressor(spark):
    with pytest.raises(ValueError):
        models.fit_regressor("other", spark.range(1), ["id"], "id")


@pytest.fixture
def noisy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 3
    frame = pd.DataFrame(x, columns=list("abcd")).assign(flat=2.0)
    frame["y"] = 5 * frame.a - 2 * frame.b + rng.normal(size=400) + 100
    return spark.createDataFrame(frame).repartition(7), frame


def standardised(frame, names):
    x, y = frame[names].to_numpy(), frame["y"].to_numpy()
    return (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()


def test_ridge_solves_the_penalised_equations(noisy):
    df, frame = noisy
    x, y = standardised(frame, list("abcd"))
    b = np.linalg.solve(x.T @ x / len(x) + 0.3 * np.eye(4), x.T @ y / len(x))
    fit = models.fit_regressor("ridge", df, list("abcd"), "y", l2=0.3)
    want = frame["y"].mean() + (x @ b) * frame["y"].std(ddof=0)
    got = models.predict(fit, df, list("abcd")).toPandas().sort_values("a")["prediction"]
    np.testing.assert_allclose(got, want[np.argsort(frame["a"].to_numpy())], rtol=1e-9)


def test_lasso_meets_its_conditions(noisy):
    """No coefficient can move: the gradient is l1 against those that are not 0, and no more than l1 at the others."""
    df, frame = noisy
    x, y = standardised(frame, list("abcd"))
    for l1 in (0.01, 0.3):
        fit = models.fit_regressor("lasso", df, list("abcd"), "y", l1=l1)
        b = np.array(fit.coefficients) * frame[list("abcd")].std(ddof=0).to_numpy() / frame["y"].std(ddof=0)
        gradient = x.T @ (y - x @ b) / len(x)
        assert all(g == pytest.approx(np.sign(c) * l1, abs=1e-9) if c else abs(g) <= l1 + 1e-9 for g, c in zip(gradient, b))
    assert 0.0 in fit.coefficients  # the larger penalty drops some


def test_constant_features_and_targets(noisy):
    df, frame = noisy
    fit = models.fit_linear(df, ["flat", "a"], "y", l2=0.1)
    assert fit.coefficients[0] == 0.0 and fit.coefficients[1] != 0.0
    flat = models.fit_linear(df, ["a"], "flat")
    assert flat.coefficients == (0.0,) and flat.intercept == pytest.approx(2.0)
    with pytest.raises(ValueError):
        models.fit_linear(df.limit(0), ["a"], "y")


@pytest.mark.parametrize("kind,params", [("random_forest", {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 8}), ("boosted_trees", {"maxIter": 2, "maxDepth": 8})])
def test_full_trees_give_group_means(spark, kind, params):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"x": rng.integers(0, 7, 300).astype(float)})
    frame["y"] = frame.x**2 % 5 + rng.normal(size=300)
    df = spark.createDataFrame(frame)
    model = models.fit_regressor(kind, df, ["x"], "y", **params)
    scored = models.predict(model, df, ["x"]).toPandas()
    means = frame.groupby("x")["y"].mean()
    np.testing.assert_allclose(scored["prediction"], means[scored["x"]].to_numpy(), rtol=1e-9)
    # The rows kept while fitting are released; MLlib may still hold a set of its own for a moment.
    assert not df.is_cached


def test_trees_are_fitted_on_small_partitions(spark, monkeypatch):
    sizes = []

    class Watched(GBTRegressor):
        def fit(self, rows, params=None):
            sizes.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(rows, params)

    monkeypatch.setitem(models.TREES, "boosted_trees", lambda: Watched(maxIter=1, maxDepth=2, seed=1))
    monkeypatch.setattr(models, "PART_ROWS", 100, raising=False)
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 3 * 2.0).alias("y"))
    for part, most in ((rows.coalesce(1), 110), (rows.limit(90).coalesce(1), 90)):
        model = models.fit_regressor("boosted_trees", part, ["a"], "y")
        assert max(sizes[-1]) <= most
        assert {round(r.prediction, 6) for r in models.predict(model, part, ["a"]).collect()} == {0.0, 2.0, 4.0}
    assert [sum(x) for x in sizes] == [1000, 90] and len(sizes[1]) == 1
