import re

import pytest
from pyspark.sql import functions as F

from marketlake.sinks import load_bucketed, save_bars, save_bucketed
from marketlake.sources import store
from suite import series
from tests.test_plans import plan_of


@pytest.fixture(scope="module")
def bars(spark):
    return series.stored(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(series.BY_TICKER))
def test_work_by_ticker_deals_no_bars(bars, name):
    """The only exchanges are those of the few splits, by the columns of their list."""
    text = plan_of(series.BY_TICKER[name](bars))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    if name.startswith("D1"):
        assert all("ticker" in d or "_groupingexpression" in d or "upper" in d for d in dealt) and "BroadcastHashJoin" in text
        above = text[: text.index("BroadcastExchange")]
        assert "Exchange hashpartitioning" not in above
    else:
        assert "Bucketed: true" in text and dealt == []


def test_buckets_are_found_by_another_session(spark, make_bars, tmp_path):
    root = str(tmp_path)
    rows = make_bars([(f" t{i % 9}", f"2024-01-{i % 20 + 1:02d}", float(i + 1), 1.0) for i in range(60)])
    path = save_bucketed(rows, root, "raw", "x", buckets=4)
    other = spark.newSession()
    spark.sql(f"DROP TABLE bars_{path.rsplit('/', 1)[1]}")  # a new session has no name for the files
    again = load_bucketed(other, root, "raw", "x")
    want = sorted((f"T{i % 9}", float(i + 1)) for i in range(60))
    assert sorted((r.ticker, r.open) for r in again.collect()) == want
    assert "Exchange" not in plan_of(again.groupBy("ticker").agg(F.sum("open")))
    assert sorted((r.ticker, r.open) for r in store.load_table(spark, root, "raw", "x").collect()) == want
    files = store.table_files(spark, root, "raw", "x").count()
    assert files <= 4


def test_replacing_buckets(spark, make_bars, tmp_path):
    root = str(tmp_path)
    for n in (3, 5):
        save_bucketed(make_bars([("A", "2024-01-02", float(n), 1.0)]), root, "raw", "x", buckets=n)
    assert [r.open for r in load_bucketed(spark, root, "raw", "x").collect()] == [5.0]
    save_bars(make_bars([("B", "2024-01-02", 1.0, 1.0)]), root, "raw", "x")
    with pytest.raises(FileNotFoundError):
        load_bucketed(spark, root, "raw", "x")
