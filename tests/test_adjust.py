import datetime

import pytest

from marketlake.operators import adjust
from marketlake.sources.events import dirty_data_table, splits_table

STACKED = [
    {"ticker": "aaa", "date": "2019-08-05", "ratio": 1.7, "in_index": True},
    {"ticker": "AAA", "date": "2025-08-13", "ratio": 2.2443, "in_index": True},
]


@pytest.fixture
def bars(make_bars):
    days = ["2019-08-02", "2019-08-05", "2025-08-12", "2025-08-13", "2025-08-14"]
    return make_bars([("AAA", d, 100.0, 100.0) for d in days] + [("BBB", days[0], 50.0, 50.0)])


def test_factors_stack_backwards(spark, bars, series):
    out = adjust.adjust_prices(bars, splits_table(spark, STACKED))
    closes = series(out, "close", "AAA")
    assert [round(c, 4) for c in closes] == [26.2102, 44.5573, 44.5573, 100.0, 100.0]
    assert series(out, "volume", "AAA") == [100.0] * 5
    assert series(out, "split_adjusted", "AAA") == [True] * 5
    assert series(out, "split_adjusted", "BBB") == [False]
    assert series(out, "close", "BBB") == [50.0]
    assert out.columns == [*bars.columns, "split_adjusted"]


def test_volume_mode_multiply(spark, bars, series):
    out = adjust.adjust_prices(
        bars, splits_table(spark, STACKED), False, "multiply"
    )
    volumes = series(out, "volume", "AAA")
    assert [round(v, 4) for v in volumes] == [381.531, 224.43, 224.43, 100.0, 100.0]


def test_index_only_leaves_other_splits_out(spark, bars, series):
    outside = [{"ticker": "AAA", "date": "2019-08-05", "ratio": 2.0}]
    out = adjust.adjust_prices(bars, splits_table(spark, outside))
    assert series(out, "close", "AAA") == [100.0] * 5
    assert series(out, "split_adjusted", "AAA") == [False] * 5
    every = adjust.adjust_prices(bars, splits_table(spark, outside), False)
    assert series(every, "close", "AAA") == [50.0, 100.0, 100.0, 100.0, 100.0]


def test_flag_is_set_even_if_no_bar_is_older(spark, make_bars, series):
    late = make_bars([("AAA", "2026-01-01", 10.0, 10.0)])
    out = adjust.adjust_prices(late, splits_table(spark, STACKED))
    assert series(out, "split_adjusted") == [True] and series(out, "close") == [10.0]


def test_rows_without_date_ticker_or_ratio(spark):
    schema = "date date, open double, high double, low double, close double, volume double, ticker string"
    day = datetime.date(2018, 1, 1)
    odd = [(None, "AAA"), (day, None), (day, "aaa")]
    bars = spark.createDataFrame([(d, 10.0, 10.0, 10.0, 10.0, 1.0, t) for d, t in odd], schema)
    splits = spark.createDataFrame(
        [("AAA", datetime.date(2019, 1, 1), 2.0, True), ("BBB", datetime.date(2019, 1, 1), None, True)],
        "ticker string, date date, ratio double, in_index boolean",
    )
    got = {(r.date, r.ticker): (r.close, r.split_adjusted) for r in adjust.adjust_prices(bars, splits).collect()}
    assert got == {(None, "AAA"): (10.0, True), (day, None): (10.0, False), (day, "aaa"): (5.0, True)}


def test_both_ways_agree(spark, bars):
    intervals = adjust.split_intervals(splits_table(spark, STACKED))
    both = [f(bars, intervals) for f in (adjust.factors_by_interval, adjust.factors_by_merge)]
    a, b = (sorted(map(tuple, df.collect()), key=str) for df in both)
    assert a == b


def test_raw_prices_come_back(spark, bars):
    intervals = adjust.split_intervals(splits_table(spark, STACKED))
    out = adjust.factors_by_interval(bars, intervals).toPandas()
    assert (out["close"] / out["split_ratio"] * out["split_ratio"]).round(9).eq(out["close"]).all()
    assert len(out) == bars.count()


def test_unknown_volume_mode(spark, bars):
    with pytest.raises(ValueError):
        adjust.adjust_prices(bars, splits_table(spark, STACKED), volume_mode="halve")


def test_counts(spark, bars):
    row = adjust.adjusted_counts(adjust.adjust_prices(bars, splits_table(spark, STACKED))).first()
    assert (row.adjusted, row.unchanged) == (1, 1)


def test_share_dividends_of_one_or_more_are_splits(spark):
    rows = [("A", 9.0, "AC"), ("B", 0.5, "AC"), ("C", 100.0, "EF"), ("D", 2.0, "BONOS"), ("E", 1.0, "AC")]
    dividends = spark.createDataFrame(
        [(t, a, "2022-07-06", k) for t, a, k in rows], "ticker string, amount double, date string, type string"
    ).selectExpr("ticker", "amount", "cast(date as date) date", "type")
    got = {r.ticker: (r.kind, r.ratio) for r in adjust.classify_actions(dividends).collect()}
    assert got == {
        "A": ("ac_split", 10.0),
        "B": ("stock_dividend", None),
        "C": ("cash_dividend", None),
        "D": ("bond_dividend", None),
        "E": ("ac_split", 2.0),
    }
    known = splits_table(spark, [{"ticker": "A", "date": "2022-07-06", "ratio": 10, "verified": True}])
    merged = adjust.splits_from_actions(dividends, known).collect()
    assert sorted((r.ticker, r.ratio, r.verified) for r in merged) == [("A", 10.0, True), ("E", 2.0, False)]


def test_dirty_values_are_nulled_and_checked(spark, bars, series):
    dirty = dirty_data_table(
        spark,
        [{"ticker": "aaa", "date": "2019-08-02", "field": "open", "value": 100, "expected_range": [140, 160]}],
    )
    out = adjust.null_dirty_values(bars, dirty)
    assert series(out, "open", "AAA") == [None, 100.0, 100.0, 100.0, 100.0]
    assert series(out, "close", "AAA") == [100.0] * 5
    assert series(out, "dirty_fields", "AAA")[0] == ["open"]
    row = adjust.out_of_range(bars, dirty).first()
    assert (row.stored, row.out_of_range) == (100.0, True)
