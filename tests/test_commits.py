import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketlake.operators.adjust import adjust_prices
from marketlake.operators.quality import listed_tickers
from marketlake.plans import ingest as plan
from marketlake.plans.adjust_all import adjust_all
from marketlake.schemas import OHLCV, OHLCV_COLUMNS
from marketlake.sinks import save_bars, save_table
from marketlake.sources import events, store
from tests.conftest import day

FROM, TO = datetime.date(2024, 1, 1), datetime.date(2024, 12, 31)


def closes(df):
    return sorted((r.ticker, str(r.date), r.close) for r in df.collect())


def failing(df):
    """The same rows, but for an error in the last one written."""
    return df.withColumn("close", F.when(F.col("close") >= 0, F.col("close")).otherwise(F.raise_error(F.lit("killed")).cast("double")))


def test_overwrite_is_all_or_nothing(spark, make_bars, tmp_path):
    root = str(tmp_path)
    old = make_bars([("A", "2024-01-02", 1.0, 1.0), ("B", "2024-01-02", 2.0, 2.0)])
    save_bars(old, root, "raw", "x")
    before = store.load_table(spark, root, "raw", "x")
    with pytest.raises(PySparkException):
        save_bars(failing(make_bars([("A", "2024-01-02", 9.0, 9.0), ("C", "2024-01-02", 1.0, -1.0)])), root, "raw", "x")
    assert closes(store.load_table(spark, root, "raw", "x")) == closes(old)
    save_bars(make_bars([("C", "2024-01-02", 3.0, 3.0)]), root, "raw", "x")
    save_bars(make_bars([("D", "2024-01-02", 4.0, 4.0)]), root, "raw", "x", mode="append")
    assert closes(store.load_table(spark, root, "raw", "x")) == [("C", "2024-01-02", 3.0), ("D", "2024-01-02", 4.0)]
    assert closes(before) == closes(old)  # a reader that began earlier keeps its files
    with pytest.raises(ValueError):
        save_bars(old, root, "raw", "x", mode="ignore")


def test_plain_files_stay_when_parts_are_added(spark, make_bars, tmp_path):
    root = str(tmp_path)
    path = store.table_path(root, "raw", plan.BARS)
    make_bars([("A", "2024-01-02", 1.0, 1.0)]).write.parquet(path)
    assert store.table_exists(spark, root, "raw", plan.BARS)
    plan.take_in(make_bars([("A", "2024-01-02", 5.0, 5.0), ("A", "2024-01-03", 2.0, 2.0)]), root)
    assert closes(plan.stored_bars(spark, root)) == [("A", "2024-01-02", 1.0), ("A", "2024-01-03", 2.0)]


def test_a_half_written_build_is_built_again(spark, make_bars, tmp_path):
    root = str(tmp_path)
    rows = make_bars([("A", "2024-01-02", 1.0, 1.0), ("B", "2024-01-02", 1.0, -1.0)])
    with pytest.raises(PySparkException):
        store.load_or_build(spark, root, "raw", "x", lambda: failing(rows))
    assert not store.table_exists(spark, root, "raw", "x")
    assert store.load_or_build(spark, root, "raw", "x", lambda: rows).count() == 2


def test_new_tickers_and_dates_need_no_stored_bars(spark, make_bars, tmp_path, monkeypatch):
    root = str(tmp_path)
    plan.take_in(make_bars([("A", "2024-01-02", 1.0, 1.0), ("A", "2024-01-05", 1.0, 1.0)]), root)
    read = []
    monkeypatch.setattr(plan, "stored_bars", lambda *a: read.append(a) or store.load_table(spark, root, "raw", plan.BARS, "v1", OHLCV))
    had, batch = plan.take_in(make_bars([("B", "2024-01-03", 2.0, 2.0), ("A", "2024-01-06", 2.0, 2.0)]), root)
    assert not read
    assert [tuple(r) for r in had.collect()] == [("A", day("2024-01-02"), day("2024-01-05"), 2)]
    assert sorted(tuple(r) for r in batch.collect()) == [
        ("A", day("2024-01-06"), day("2024-01-06"), 1),
        ("B", day("2024-01-03"), day("2024-01-03"), 1),
    ]
    plan.take_in(make_bars([("A", "2024-01-03", 3.0, 3.0), ("A", "2024-01-05", 9.0, 9.0)]), root)  # within the range
    assert len(read) == 1
    assert closes(store.load_table(spark, root, "raw", plan.BARS)) == [
        ("A", "2024-01-02", 1.0), ("A", "2024-01-03", 3.0), ("A", "2024-01-05", 1.0), ("A", "2024-01-06", 2.0), ("B", "2024-01-03", 2.0),
    ]


def test_the_ledger_tells_what_is_stored(spark, make_bars, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        plan.take_in(make_bars([("A", f"2024-01-0{i + 1}", 1.0, 1.0), (f"T{i}", "2024-02-01", 1.0, 1.0), (None, "2024-02-01", 1.0, 1.0)]), root)
    ledger = sorted(map(str, map(tuple, plan.stored_ledger(spark, root).collect())))
    bars = plan.stored_bars(spark, root).groupBy("ticker").agg(F.min("date"), F.max("date"), F.count("*"))
    assert ledger == sorted(map(str, map(tuple, bars.collect()))) and len(ledger) == 5
    plans = plan.stored_ledger(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "_ledger" in plans and "close" not in plans
    assert [r.ticker for r in listed_tickers(plan.stored_ledger(spark, root)).collect()] == [None, "A", "T0", "T1", "T2"]
    batches = store.update_batches(spark, root, "raw", plan.BARS).orderBy("batch").collect()
    assert [(r.batch, r.rows) for r in batches] == [(1, 3), (2, 2), (3, 2)]
    assert all(r.files >= 1 and r["bytes"] > 0 for r in batches)
    assert [r.updated for r in batches] == sorted(r.updated for r in batches)


def test_a_killed_ingest_leaves_nothing(spark, make_bars, tmp_path, monkeypatch):
    root = str(tmp_path)
    plan.take_in(make_bars([("A", "2024-01-02", 1.0, 1.0)]), root)
    bars = make_bars([("B", "2024-01-02", 2.0, 2.0)])
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            plan.take_in(bars, root)
    assert closes(plan.stored_bars(spark, root)) == [("A", "2024-01-02", 1.0)]
    assert plan.stored_ledger(spark, root).count() == 1
    plan.take_in(bars, root)
    plan.take_in(bars, root)
    assert closes(plan.stored_bars(spark, root)) == [("A", "2024-01-02", 1.0), ("B", "2024-01-02", 2.0)]


@pytest.fixture
def adjusted(spark, make_bars, tmp_path):
    root = str(tmp_path)
    raw = make_bars([(f"T{i}", f"2024-01-0{d}", 8.0, 8.0) for i in range(30) for d in (2, 3)])
    save_bars(raw, root, "raw", plan.BARS)
    splits = events.splits_table(spark, [{"ticker": "T3", "date": "2024-01-03", "ratio": 2}, {"ticker": "T4", "date": "2024-01-03", "ratio": 4}])
    adjust_all(spark, root, splits, buckets=8)
    return root, raw, splits


def parts_of(spark, root):
    return {r["slot"]: r["folder"] for r in store.current_parts(spark, store.table_path(root, "processed", plan.BARS))}


def test_one_ticker_rewrites_its_bucket(spark, adjusted):
    root, raw, splits = adjusted
    before = parts_of(spark, root)
    more = splits.union(events.splits_table(spark, [{"ticker": "T5", "date": "2024-01-03", "ratio": 8}]))
    asked = spark.createDataFrame([("t5",)], "ticker string")
    assert [tuple(r) for r in adjust_all(spark, root, more, asked, buckets=8).collect()] == [("T5", True, 2, "written")]
    after = parts_of(spark, root)
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    want = adjust_prices(raw, more, index_only=False, volume_mode="multiply").select(*OHLCV_COLUMNS)
    got = store.load_table(spark, root, "processed", plan.BARS, schema=OHLCV)
    assert closes(got) == closes(want)


def test_a_killed_adjustment_leaves_the_table(spark, adjusted, make_bars, monkeypatch):
    root, raw, splits = adjusted
    old = closes(store.load_table(spark, root, "processed", plan.BARS, schema=OHLCV))
    bad = failing(raw.unionByName(make_bars([("T9", "2024-01-04", 1.0, -1.0)])))
    monkeypatch.setattr("marketlake.plans.adjust_all.adjust_prices", lambda *a, **k: bad.withColumn("split_adjusted", F.lit(False)))
    for asked in (None, spark.createDataFrame([("T9",)], "ticker string")):
        with pytest.raises(PySparkException):
            adjust_all(spark, root, splits, asked, buckets=8)
        assert closes(store.load_table(spark, root, "processed", plan.BARS, schema=OHLCV)) == old


def test_other_layouts_are_written_anew(spark, adjusted, make_bars):
    root, raw, splits = adjusted
    asked = spark.createDataFrame([("T1",)], "ticker string")
    old = closes(store.load_table(spark, root, "processed", plan.BARS, schema=OHLCV))
    adjust_all(spark, root, splits, asked, buckets=5)
    assert closes(store.load_table(spark, root, "processed", plan.BARS, schema=OHLCV)) == old
    assert {s.split("/")[-1] for s in parts_of(spark, root)} <= {"5", "*"}
    save_table(raw, root, "processed", plan.BARS)
    adjust_all(spark, root, splits, asked)
    assert closes(store.load_table(spark, root, "processed", plan.BARS, schema=OHLCV)) == closes(raw)
