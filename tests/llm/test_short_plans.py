import random

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from marketlake.llm import minhash_dedup, mixing
from marketlake.llm._tables import components, stored


@pytest.fixture
def plans(monkeypatch):
    """How many operators the plan of each written table has."""
    found, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        name = path.rsplit("/", 1)[-1].rsplit("-", 1)[0]
        found[name] = max(found.get(name, 0), plan.count("\n"))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return found


def test_components_are_found_by_short_plans(spark, plans):
    """The driver keeps each plan, and gets it anew after each shuffle, so long plans fill its memory."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 50)], "a long, b long")
    got = {r.id: r.component for r in components(edges, "short").collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}
    assert 0 < max(plans.values()) <= 30, plans


def test_near_copies_are_found_by_short_plans(spark, plans):
    draw = random.Random(5)
    texts = [" ".join(draw.choices("abcdefghijklmnopqrst", k=60)) for _ in range(6)]
    rows = [(i, texts[i % 6] + " z" * (i // 6)) for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: i % 6 for i in range(18)}
    assert 0 < max(plans.values()) <= 45, plans


def test_targets_are_found_by_short_plans(spark, plans):
    sizes = spark.createDataFrame([("a", 10), ("b", 20), ("c", 3), (None, 7)], "source string, source_size long")
    got = {r.source: (r.source_size, r.target) for r in stored(mixing.targets(sizes), "mix-targets").collect()}
    # The third, of 3 words, is held at 9; the other 31 are shared by 1, 2 and 1.
    assert got == {"a": (10, 7.75), "b": (20, 15.5), "c": (3, 9.0), None: (7, 7.75)}
    assert 0 < max(plans.values()) <= 40, plans
