"""What the plans of the heavy queries look like, and the operators behind them."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from marketlake.operators import adjust, gaps
from marketlake.operators.digest import days_digest, merged_digests
from marketlake.plans import ingest as plan
from marketlake.schemas import OHLCV_COLUMNS
from marketlake.sources import responses
from suite import catalog
from tests.conftest import day

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, what):
    return len(re.findall(rf"(?<![\w]){what}", text))


@pytest.mark.parametrize("name", ["U3_first_seen", "W5_overnight_gap", "W6_gap_context", "D4_gap_report", "X2_classified_alerts", "flagship_adjusted_gaps"])
def test_nothing_is_sorted_to_be_aggregated(spark, name):
    assert "SortAggregate" not in plan_of(catalog.QUERIES[name](spark, SF))


def test_ingest_sorts_nothing_to_aggregate(spark, make_bars, tmp_path):
    bars = plan.one_per_day(make_bars([("A", "2024-01-02", 1.0, 1.0)]))
    assert "SortAggregate" not in plan_of(bars) and bars.count() == 1


def test_exchanges_of_the_chain(spark):
    fixture = count(plan_of(catalog.QUERIES["P1_canonical_bars"](spark, SF)), "Exchange hashpartitioning")
    flagship = plan_of(catalog.QUERIES["flagship_adjusted_gaps"](spark, SF))
    bars_only = [x for x in re.findall(r"Exchange hashpartitioning\((\w+)", flagship) if x in ("instrument", "l_suppkey")]
    assert bars_only.count("instrument") == 1 and len(bars_only) == fixture + 1  # beyond the fixture one for the bars; the window's serves the totals
    assert count(flagship, "Window ") <= 2  # one over bars, one over splits
    w6 = plan_of(catalog.QUERIES["W6_gap_context"](spark, SF))
    assert count(w6, "Window ") == 1 and count(w6, "Exchange hashpartitioning") == fixture + 1


def test_totals_do_not_expand(spark):
    for name in ("A15_analysed_totals", "A6_dataset_summary", "A7_source_coverage"):
        assert "Expand" not in plan_of(catalog.QUERIES[name](spark, SF))


def test_the_weight_grid_scans_few_times(spark):
    text = plan_of(catalog.QUERIES["J6_weight_grid"](spark, SF))
    assert count(text, "FileScan") <= 3


def test_first_seen_equals_the_smallest_row(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([1.0, 2.0, -1.0, 3.5])
    rows = [(s, rng.choice("AB"), day(f"2024-01-{rng.randrange(1, 9):02d}"), rng.choice([value(), None]), value()) for s in range(3) for _ in range(40)]
    schema = "source int, instrument string, date date, open double, close double"
    df = spark.createDataFrame(rows, schema)
    sources = [df.filter(F.col("source") == s).drop("source") for s in range(3)]
    want = {}
    for s, i, d, o, c in rows:
        rank = (o is None, s, o or 0.0, c)
        if (i, d) not in want or rank < want[i, d][0]:
            want[i, d] = rank, (o, c)
    got = {(r.instrument, r.date): (r.open, r.close) for r in gaps.first_seen(sources).collect()}
    assert got == {k: v for k, (_, v) in want.items()}
    alone = gaps.first_seen(sources[:1], unique=True)
    assert alone.count() == sources[0].count()


def test_one_per_day_equals_the_smallest_bar(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([1.0, 2.0, None])
    rows = [(day(f"2024-01-{rng.randrange(1, 6):02d}"), *[value() for _ in range(5)], rng.choice(["A", "B", None])) for _ in range(60)]
    rows += [rows[0]] * 5 + [(day("2024-02-01"), None, None, None, None, None, "C")] * 2
    df = spark.createDataFrame(rows, "date date, open double, high double, low double, close double, volume double, ticker string")
    low = lambda x: (x is not None, x or 0.0)
    want = {}
    for r in rows:
        key = (r[6], r[0])
        if key not in want or tuple(map(low, r[1:6])) < tuple(map(low, want[key])):
            want[key] = r[1:6]
    got = {(r.ticker, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in plan.one_per_day(df).collect()}
    assert got == want


def test_a_second_ingest_writes_no_bars_again(spark, make_bars, tmp_path, monkeypatch):
    """What is stored already goes neither into the aggregate nor into the scratch folder, and nothing is looked up in an empty store."""
    kept, looked = [], []
    written, unseen = plan.written, plan._unseen
    monkeypatch.setattr(plan, "written", lambda df, name: kept.append((name, df.count(), df.columns)) or written(df, name))
    monkeypatch.setattr(plan, "_unseen", lambda *a: looked.append(a) or unseen(*a))
    days = [f"2024-01-{d:02d}" for d in range(2, 22)]
    bars = make_bars([(t, d, 1.0, 2.0) for t in ("A", "B", None) for d in days])
    more = bars.unionByName(make_bars([("A", "2024-02-01", 3.0, 3.0), ("A", "2024-02-01", 3.0, 4.0), ("C", "2024-01-02", 1.0, 1.0), ("C", "2024-01-02", 1.0, 1.0)]))
    for df in (bars, bars, more):
        plan.take_in(df, str(tmp_path))
    assert [(name, n) for name, n, _ in kept] == [("days", 60), ("days", 0), ("days", 2)] and len(looked) == 2
    assert all(set(columns) == {*OHLCV_COLUMNS, "_alike"} for _, _, columns in kept)
    got = plan.stored_bars(spark, str(tmp_path))
    assert got.count() == 62 and [r.close for r in got.filter("date = '2024-02-01'").collect()] == [3.0]


def test_kept_responses_hold_numbers(spark):
    body = '{"series": [{"c": "1.5", "d": "2024-01-02T00:00:00Z", "h": 2, "l": 1, "o": null, "r": "D", "sid": "x", "v": 3}, null, {}]}'
    bad = body.replace("1.5", "?")
    df = spark.createDataFrame([("A", body), ("B", bad), ("C", "[]"), (None, '{"series": []}')], "ticker string, body string")
    checked = responses.validated(df)
    kept = responses.as_numbers(checked)
    assert "sid" not in kept.schema.simpleString() and "d:string,o:double" in kept.schema.simpleString()
    flags = lambda x: sorted(map(str, x.select("ticker", "valid", "readable").collect()))
    assert flags(kept) == flags(checked)
    rows = lambda x: sorted(map(str, responses.bars_of(x).collect()))
    assert rows(kept) == rows(checked) and len(rows(kept)) == 3


def test_ladder_equals_the_merge(spark, make_bars):
    rng = random.Random(5)
    start = datetime.date(2024, 1, 1)
    bars = make_bars([(t, str(start + datetime.timedelta(i)), 8.0, 8.0) for t in ("A", "b", None) for i in range(30)])
    bars = bars.unionByName(bars.limit(1).withColumn("date", F.lit(None).cast("date")))
    rows = [(rng.choice(["a", "B", "C", None]), start + datetime.timedelta(rng.randrange(-3, 35)), rng.choice([2.0, 3.0, 0.5])) for _ in range(12)]
    intervals = adjust.split_intervals(spark.createDataFrame(rows, "ticker string, date date, ratio double"))
    sides = [f(bars, intervals).select("split_ratio", "ticker", "date", "split_adjusted") for f in (adjust.factors_by_ladder, adjust.factors_by_merge)]
    ladder, merge = (sorted(map(str, map(tuple, s.collect()))) for s in sides)
    assert ladder == merge and len(ladder) == 91


def test_digests_merge_exactly(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ABC"), datetime.date(1899, 12, 1) + datetime.timedelta(rng.randrange(90000))) for _ in range(800)]
    rows += [("A", None), (None, datetime.date(2024, 12, 31)), ("A", datetime.date(2024, 12, 31))]
    df = spark.createDataFrame(rows, "instrument string, date date")
    totals = gaps.analysed_totals(df).first()
    assert tuple(totals) == (len(rows), 3, len({d for _, d in rows if d}))
    parts = [days_digest(df.filter((F.crc32(F.col("date").cast("string").cast("binary")) % 2) == i), "instrument") for i in (0, 1)]
    nulls = days_digest(df.filter("date IS NULL"), "instrument")
    merged = merged_digests(parts[0].unionByName(parts[1]).unionByName(nulls), "instrument")
    as_rows = lambda d: sorted(map(str, map(tuple, d.collect())))
    assert as_rows(merged) == as_rows(days_digest(df, "instrument"))
    assert tuple(gaps.analysed_totals(df.limit(0)).first()) == (0, 0, 0)


def test_lower_case_bars_meet_upper_case_lists(spark, make_bars):
    bars = make_bars([("aa", "2024-01-02", 1.0, 1.0)])
    events = spark.createDataFrame([(["AA"], day("2024-01-02"), "positive")], "tickers_affected array<string>, date date, direction string")
    assert gaps.event_dummies(bars, events).first().macro_event == 1
    known = spark.createDataFrame([("aa", day("2024-01-02"), 2.0, True, True, "")], "ticker string, date date, ratio double, in_index boolean, verified boolean, notes string")
    actions = spark.createDataFrame([("AA", 1.0, day("2024-01-02"), "AC")], "ticker string, amount double, date date, type string")
    assert adjust.splits_from_actions(actions, known).count() == 1


def test_gap_report_of_one_instrument_with_context(spark, make_bars):
    from marketlake.plans.gap_report import gap_report

    bars = make_bars([(t, f"2024-01-0{i}", c, c) for t in ("A", "B") for i, c in enumerate((1.0, 2.0, 2.0), 1)])
    (alert,) = gap_report(bars, instrument="a", context=True).collect()
    assert alert.instrument == "A" and [c.is_event for c in alert.context] == [False, True, False]
    assert alert.context[1].var_dia_pct == 100.0 and alert.en_indice is None
