import pytest

from __spark_entry__ import entry, oracle_sql, queries
from marketlake.plans.joins import join_by_date
from marketlake.plans.scratch import checkpointed, scratch_path, scratch_root

# The operator ids that a registered query must cover; S12 has no query.
OPERATORS = (
    [f"S{i}" for i in range(1, 17) if i != 12]
    + [f"K{i}" for i in range(1, 8)]
    + [f"P{i}" for i in range(1, 12)]
    + [f"J{i}" for i in range(1, 8)]
    + [f"A{i}" for i in range(1, 19)]
    + [f"W{i}" for i in range(1, 10)]
    + [f"O{i}" for i in range(1, 5)]
    + [f"U{i}" for i in range(1, 4)]
    + [f"D{i}" for i in range(1, 7)]
    + [f"X{i}" for i in range(1, 9)]
    + [f"Y{i}" for i in range(1, 8)]
)


def test_every_operator_has_a_query():
    covered = {name.split("_")[0] for name in queries()}
    assert [o for o in OPERATORS if o not in covered] == []


def test_every_query_has_sql():
    own = [n for n in queries() if not n.startswith("op") and n != "pipeline"]
    assert [n for n in own if n not in oracle_sql()] == []


def test_flagship(spark):
    df = entry(spark)
    assert df.columns == ["ticker", "n_alerts", "largest"] and df.count() == 10


def test_broadcast_needs_a_date(spark):
    days = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS date, 1 AS total")
    with pytest.raises(TypeError):
        join_by_date(days.select("date"), days)


def test_scratch(spark):
    assert scratch_path(spark, "a").startswith(scratch_root(spark))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert checkpointed(spark.range(3)).count() == 3


@pytest.mark.parametrize("name", ["W1_daily_return", "D1_adjust_index_splits", "A4_quarterly_weight"])
def test_plans_have_no_cross_join(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_update_batches_count_the_table(spark):
    """One row per batch, with counts that follow the bars."""
    assert "ohlcv" in oracle_sql()["A9_update_batches"]
    sf = "/root/testdata/sf0.001"
    got = {r.batch: (r.n, r.newer) for r in queries()["A9_update_batches"](spark, sf).collect()}
    bars = queries()["A9_bars_summary"](spark, sf).first()
    assert got.keys() == {1, 2} and got[1][1] is None and got[2][1] is True
    assert min(n for n, _ in got.values()) > 0 and bars.date_min.year < 1998 <= bars.date_max.year
