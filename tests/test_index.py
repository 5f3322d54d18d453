import datetime

import pytest

from marketlake.operators import features, index, quality
from tests.conftest import day


@pytest.fixture
def composition(spark):
    rows = [
        ("2024-01-02", "A", 2.0, 10.0),
        ("2024-01-02", "B", 1.0, 20.0),
        ("2024-01-05", "A", 2.0, 30.0),
        ("2024-01-05", "B", None, 20.0),
        ("2024-04-01", "A", 1.0, None),  # total of zero: dropped from weights
        ("2024-05-01", "C", 1.0, 5.0),
    ]
    return spark.createDataFrame(
        [(day(d), t, q, c) for d, t, q, c in rows], "date date, ticker string, quantity double, close double"
    )


def dates(spark, *texts):
    return spark.createDataFrame([(day(t),) for t in texts], "date date")


def test_composition_as_of(composition):
    exact = index.composition_at(composition, day("2024-01-05"))
    between = index.composition_at(composition, day("2024-03-01"))
    assert exact.count() == 2 and sorted(map(tuple, between.collect())) == sorted(map(tuple, exact.collect()))
    with pytest.raises(ValueError):
        index.composition_at(composition, day("2024-01-01"))


def test_many_targets(spark, composition):
    targets = dates(spark, "2024-01-01", "2024-01-02", "2024-01-04", "2024-02-01", "2024-02-01")
    got = {(str(r.date), str(r.resolved)) for r in index.compositions_at(composition, targets).collect()}
    assert got == {
        ("2024-01-02", "2024-01-02"),
        ("2024-01-04", "2024-01-02"),
        ("2024-02-01", "2024-01-05"),
    }
    resolved = {str(r.date): r.resolved for r in index.as_of_dates(targets, composition).collect()}
    assert resolved["2024-01-01"] is None and len(resolved) == 4


def test_weights_add_up_and_empty_days_go(composition):
    weights = index.daily_weights(composition).toPandas()
    sums = weights.groupby("date")["weight"].sum()
    assert list(sums.round(9)) == [100.0, 100.0, 100.0]
    assert len(weights) == 5 and day("2024-04-01") not in set(weights["date"])
    quarterly = {(r.quarter, r.ticker): r.weight for r in index.quarterly_weights(composition).collect()}
    assert quarterly == {("2024-Q1", "A"): 75.0, ("2024-Q1", "B"): 25.0, ("2024-Q2", "C"): 100.0}


def test_grids_are_dense(composition):
    weights = {(r.ticker, r.quarter): r.weight for r in index.weight_matrix(composition).collect()}
    assert len(weights) == 6 and weights[("C", "2024-Q1")] == 0.0 and weights[("C", "2024-Q2")] == 100.0
    present = {(r.ticker, r.quarter): r.present for r in index.presence_matrix(composition).collect()}
    assert present == {
        ("A", "2024-Q1"): 1, ("A", "2024-Q2"): 1, ("B", "2024-Q1"): 1,
        ("B", "2024-Q2"): 0, ("C", "2024-Q1"): 0, ("C", "2024-Q2"): 1,
    }


def test_weights_at_a_date(composition):
    got = {r.ticker: r.weight for r in index.weights_at(composition, day("2024-01-03")).collect()}
    assert got == {"A": 50.0, "B": 50.0}
    assert index.weights_at(composition, day("2024-04-02")).first().weight is None


def test_ticker_lists_and_coverage(composition):
    sources = {"historica": composition, "vigente": composition.filter("ticker = 'A'")}
    assert sorted(r.ticker for r in index.unique_tickers(sources).collect()) == ["A", "B", "C"]
    assert index.unique_tickers(sources, ["other"]).count() == 0
    row = index.source_coverage(sources, ["vigente", "other"]).first()
    assert (row.source, row.n_dates, row.date_max) == ("vigente", 3, day("2024-04-01"))


def test_reconstruction_uses_the_divisor_in_force(spark, composition):
    divisor = spark.createDataFrame(
        [(day("2024-01-01"), 2.0), (day("2024-01-04"), 4.0)], "date date, divisor double"
    )
    spot = spark.createDataFrame([(day("2024-01-05"), 14.0)], "date date, value double")
    got = {str(r.date): r for r in index.reconstructed_index(composition, divisor, spot).collect()}
    assert got["2024-01-02"].rebuilt == 20.0 and got["2024-01-02"].value is None
    assert got["2024-01-05"].rebuilt == 15.0 and got["2024-01-05"].difference == 1.0
    summary = index.index_summary(spot, divisor).first()
    assert (summary.n_days, summary.value_max, summary.current_divisor) == (1, 14.0, 4.0)
    both = index.spot_with_divisor(spot, divisor, "MAX", day("2024-06-01"))
    assert both.count() == 3


def test_dataset_summary(composition):
    rows = {r.dataset: r for r in index.dataset_summary({"a": composition, "b": composition.drop("ticker")}).collect()}
    assert (rows["a"].n_rows, rows["a"].n_tickers, rows["b"].n_tickers) == (6, 3, None)


def test_business_days_by_counting(spark):
    from pyspark.sql import functions as F

    from marketlake.functions import business_days

    start = day("2023-12-25")
    pairs = [(start + datetime.timedelta(a), start + datetime.timedelta(a + n)) for a in range(8) for n in range(20)]
    df = spark.createDataFrame(pairs, "a date, b date").withColumn("n", business_days(F.col("a"), F.col("b")))
    for r in df.collect():
        want = sum((r.a + datetime.timedelta(i)).weekday() < 5 for i in range((r.b - r.a).days + 1))
        assert r.n == want


def test_ticker_stats(make_bars):
    # Friday, Saturday, Tuesday: three working days between, one of them without a bar
    bars = make_bars([("A", d, 1.0, 1.0) for d in ("2024-01-05", "2024-01-06", "2024-01-09")])
    row = quality.ticker_stats(bars).first()
    assert (row.n_rows, row.expected_bdays, row.missing_bdays) == (3, 3, 1)


def test_coverage_matrix(spark, make_bars):
    bars = make_bars([("A", f"2020-01-{i:02d}", 1.0, 1.0) for i in range(1, 9)] + [("B", f"2020-02-{i:02d}", 1.0, 1.0) for i in range(1, 4)])
    named = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    got = {(r.ticker, r.year): r.coverage for r in quality.coverage_matrix(bars, range(2020, 2022), named).collect()}
    assert got == {("A", 2020): 100.0, ("A", 2021): 0.0, ("B", 2020): 37.5, ("B", 2021): 0.0, ("C", 2020): 0.0, ("C", 2021): 0.0}


def test_calendar_alignment(make_bars):
    bars = make_bars([("A", d, 1.0, 2.0) for d in ("2024-01-04", "2024-01-06", "2024-01-10")])
    got = quality.align_to_calendar(bars, [day("2024-01-08")]).orderBy("date").collect()
    assert [(str(r.date), r.missing, r.close) for r in got] == [
        ("2024-01-04", False, 2.0),
        ("2024-01-05", True, None),
        ("2024-01-09", True, None),
        ("2024-01-10", False, 2.0),
    ]


def test_split_by_time_is_monotone(make_series):
    df = features.split_by_time(make_series([1.0] * 20)).orderBy("date").collect()
    assert [r.part for r in df] == ["train"] * 14 + ["validation"] * 3 + ["test"] * 3


@pytest.mark.parametrize("shares", [(0.7, 0.2, 0.2), (1.0, 0.0, 0.0), (0.5, 0.6, -0.1)])
def test_bad_shares(shares):
    with pytest.raises(ValueError):
        features.check_shares(*shares)


def test_run_totals(spark):
    status = spark.createDataFrame(
        [("A", True, ""), ("B", False, "invalid response")], "ticker string, ok boolean, reason string"
    )
    assert tuple(quality.run_totals(status).first()) == (1, 1, 2)
    assert [r.ticker for r in quality.failed_tickers(status).collect()] == ["B"]
