"""Results whose order is what the operator is for: as they come out of Spark, not sorted again."""

import pytest

from suite import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith(("O1_", "O2_", "O3_", "S9_"))])
def test_rows_come_in_order(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) > 1
    column = next(c for c in ("date", "quarter", "ticker") if c in df.columns)
    values = [r[df.columns.index(column)] for r in rows]
    assert values in (sorted(values), sorted(values, reverse=True))
