import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.operators import candles, returns, selection
from tests.conftest import day


def test_returns_over_a_zero_price(make_series, series):
    bars = make_series([10.0, 12.0, 0.0, 5.0, 6.0])
    got = series(returns.daily_returns(bars), "ret")
    assert got[0] is None and got[3] is None
    assert [round(x, 6) for x in (got[1], got[2], got[4])] == [20.0, -100.0, 20.0]
    assert [round(x, 6) for x in series(returns.cumulative_return(bars), "cumulative")] == [
        0.0, 20.0, -100.0, -100.0, -100.0,
    ]


def test_pairs_leave_out_unusable_previous_closes(make_series):
    pairs = returns.return_pairs(make_series([10.0, 0.0, 5.0, 6.0]))
    assert [round(r.ret, 6) for r in pairs.orderBy("date").collect()] == [-100.0, 20.0]


def test_range_comes_before_the_lag(make_series, series):
    bars = make_series([10.0, 12.0, 15.0])
    inside = selection.date_range(bars, day("2024-01-02"), day("2024-01-03"))
    assert series(returns.daily_returns(inside), "ret")[0] is None


def test_null_close_gives_null(make_series, series):
    got = series(returns.daily_returns(make_series([10.0, None, 12.0])), "ret")
    assert got == [None, None, None]


def test_rebased_starts_at_100(make_series, series):
    assert series(returns.rebased(make_series([50.0, 25.0, 75.0])), "rebased") == [100.0, 50.0, 150.0]
    # a zero first price divides by one
    assert series(returns.rebased(make_series([0.0, 2.0])), "rebased") == [0.0, 200.0]


def test_moving_average_needs_n_rows(make_series, series):
    got = series(candles.moving_averages(make_series([1.0, 2.0, 3.0, 4.0]), (3,)), "sma3")
    assert got == [None, None, 2.0, 3.0]
    short = candles.moving_averages(make_series([1.0, 2.0]), (3,))
    assert series(short, "sma3") == [None, None]


def test_rolling_volatility_matches_a_loop(make_series, series):
    closes = [10.0, 11.0, 0.0, 12.0, 11.5, 13.0, 12.0, 12.5]
    window = 3
    rets = [None] + [b / a - 1 if a else None for a, b in zip(closes, closes[1:])]
    want = []
    for i in range(len(closes)):
        seen = [r for r in rets[max(0, i - window + 1) : i + 1] if r is not None]
        full = i >= window and len(seen) >= 2
        want.append(np.std(seen, ddof=1) * math.sqrt(252) * 100 if full else None)
    vol = returns.rolling_volatility(make_series(closes), window)
    got = series(vol, "volatility")
    assert [g is None for g in got] == [w is None for w in want]
    assert all(g == pytest.approx(w) for g, w in zip(got, want) if w is not None)
    mean = returns.mean_volatility(vol).first().mean_volatility
    assert mean == pytest.approx(np.mean([w for w in want if w is not None]))
    assert returns.mean_volatility(returns.rolling_volatility(make_series([1.0]), 3)).first().mean_volatility == 0.0


def test_moments_equal_pandas(spark):
    values = [1.0, -2.0, 3.5, 0.25, 9.0, -4.0]
    df = spark.createDataFrame([("A", v) for v in values], "ticker string, ret double")
    row = returns.return_moments(df).first()
    s = pd.Series(values)
    assert row.n == 6
    assert row.mean == pytest.approx(s.mean())
    assert row.std_pop == pytest.approx(s.std(ddof=0))
    assert row.std_samp == pytest.approx(s.std())
    assert row.skew == pytest.approx(s.skew())
    assert row.kurtosis == pytest.approx(s.kurtosis())


def test_moments_of_short_and_flat_series(spark):
    rows = [("A", 1.0), ("A", 2.0), ("B", 1.0), ("B", 1.0), ("B", 1.0), ("B", 1.0)]
    df = spark.createDataFrame(rows, "ticker string, ret double")
    got = {r.ticker: r for r in returns.return_moments(df).collect()}
    assert got["A"].skew is None and got["A"].kurtosis is None
    assert got["B"].skew == 0.0 and got["B"].kurtosis == 0.0
    flags = {r.ticker: (r.skewed, r.heavy_tails) for r in returns.tail_flags(returns.return_moments(df)).collect()}
    assert flags == {"A": (False, False), "B": (False, False)}


def test_histogram_counts_the_maximum_and_sums_to_one(spark):
    values = [float(v) for v in range(101)]
    df = spark.createDataFrame([("A", v) for v in values] + [("B", 3.0)], "ticker string, ret double")
    bins = returns.histogram(df).filter("ticker = 'A'").toPandas()
    assert bins["n"].sum() == 101 and bins["bin"].max() == 49
    assert (bins["density"] * 2).sum() == pytest.approx(1.0)
    flat = returns.histogram(df).filter("ticker = 'B'").first()
    assert (flat.bin, flat.n, flat.density) == (0, 1, None)


def test_normal_curve_has_its_peak_at_the_mean(spark):
    df = spark.createDataFrame([("A", float(v)) for v in (-1, 0, 1)], "ticker string, ret double")
    curve = returns.normal_curve(df, points=3).orderBy("point").collect()
    assert [c.x for c in curve] == [-1.0, 0.0, 1.0]
    assert curve[1].density == pytest.approx(1 / math.sqrt(2 * math.pi))


def test_distribution(spark):
    df = spark.createDataFrame([("A", float(v)) for v in (1, 2, 3, 4)], "ticker string, ret double")
    row = returns.distribution(df).first()
    assert (row.q1, row.median, row.q3, row.min, row.max) == (1.75, 2.5, 3.25, 1.0, 4.0)


def test_aligned_and_wide_returns_agree(make_bars):
    rows = [("A", f"2024-01-{d:02d}", 1.0, float(d)) for d in range(1, 13)]
    rows += [("B", f"2024-01-{d:02d}", 1.0, float(d)) for d in range(3, 14)]
    rows += [("C", f"2024-01-{d:02d}", 1.0, float(d)) for d in range(1, 5)]  # too short
    bars = make_bars(rows)
    long = returns.aligned_returns(bars).toPandas()
    wide = returns.wide_returns(bars, ["A", "B"]).toPandas().set_index("date").sort_index()
    assert set(long["ticker"]) == {"A", "B"}
    again = long.pivot(index="date", columns="ticker", values="ret").sort_index()
    assert list(again.index) == list(wide.index)
    np.testing.assert_allclose(again["A"], wide["A"])
    np.testing.assert_allclose(again["B"], wide["B"])
    assert wide["B"].isna().sum() > 0


def test_forward_returns(make_series, series):
    got = returns.forward_returns(make_series([10.0, 11.0, 0.0, 12.0]), (1, 3))
    assert series(got, "target_1")[0] == pytest.approx(0.1)
    assert series(got, "target_1")[2] is None and series(got, "target_1")[3] is None
    assert series(got, "target_3") == [pytest.approx(0.2), None, None, None]


def test_trailing_range_clips_to_the_end_of_month(make_bars):
    bars = make_bars([("A", "2024-02-28", 1.0, 1.0), ("A", "2024-02-29", 1.0, 1.0), ("A", "2024-05-31", 1.0, 1.0)])
    assert selection.trailing_range(bars, "3M", day("2024-05-31")).count() == 2
    assert selection.trailing_range(bars, "MAX", day("2024-05-31")).count() == 3
    with pytest.raises(ValueError):
        selection.trailing_range(bars, "2W", day("2024-05-31"))
    assert selection.trailing_range(bars, "2W", day("2024-05-31"), day("2024-03-01")).count() == 1


def test_comparison_modes(make_series, series):
    bars = make_series([10.0, 20.0])
    assert series(returns.comparison(bars, "base100"), "value") == [100.0, 200.0]
    assert series(returns.comparison(bars, "cumulative"), "value") == [0.0, 100.0]
    with pytest.raises(ValueError):
        returns.comparison(bars, "other")


def test_candlestick_averages_start_inside_the_range(make_series, series):
    bars = make_series([float(i) for i in range(1, 31)])
    frame = candles.candlestick(bars, day("2024-01-05"), None)
    got = series(frame, "sma20")
    assert got[18] is None and got[19] == pytest.approx(sum(range(5, 25)) / 20)
    assert frame.filter(F.col("up")).count() == 26


def test_minimum_history(make_series):
    bars = make_series([1.0] * 10, "A").unionByName(make_series([1.0] * 9, "B"))
    assert {r.ticker for r in selection.with_history(bars, 10).collect()} == {"A"}
