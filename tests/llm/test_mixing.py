import numpy as np
import pytest

from marketlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, class string, level string"


def docs_of(spark, rows):
    """Rows (doc_id, text, source), with other columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain_targets(sizes, weights, most=3.0):
    """Shares by weight; what exceeds a limit is shared again until nothing does."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        rest = [s for s in order if s not in full]
        shared = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if shared[s] > most * sizes[s]]
        if not over:
            return full | shared
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1000, "b": 1, "c": 2, "d": 500, None: 3},
        {"a": 5, "b": 0, "c": 7},
        {"B": 10, "a": 10, "é": 10, "": 100000, "z": 1},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes, (1.0, 2.0, 3.0))
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_pivot_keeps_words_and_means():
    sizes = np.array([9.0, 7, 5, 4, 3, 2, 1, 1])
    runs = np.zeros(len(sizes))
    for seed in range(4000):
        parts, hand = mixing.pivot([str(i) for i in range(8)], sizes, np.full(8, 0.3), seed)
        assert parts @ sizes == pytest.approx(0.3 * sizes.sum())
        assert sum(0 < p < 1 for p in parts) <= 1 and (hand < 0 or 0 < parts[hand] < 1)
        runs += parts
    assert runs / 4000 == pytest.approx(np.full(8, 0.3), abs=0.04)


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 40)), "ab"[i % 3 // 2] if i % 7 else None) for i in range(3000)]
    rows += [(3000, None, "a"), (3001, "", "b"), (None, "one two", "a"), (5, "same id", "a"), (5, "same id", "a"), (3002, "v " * 9000, "a")]
    docs = docs_of(spark, rows)
    first, again = (sorted(map(tuple, mixing.copies(docs).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    taken, sizes, target = {}, {}, {}
    for _, _, source, size, source_size, t, copies in first:
        assert 0 <= copies <= 3 and (size or not copies)
        taken[source] = taken.get(source, 0) + copies * size
        sizes[source], target[source] = source_size, t
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in taken:
        assert abs(taken[s] - target[s]) <= 9000
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[-1] for r in first)


def test_blocks_form_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(i, "w " * (1 + i % 50), "one" if i % 3 else "two") for i in range(2000)]
    got = mixing.copies(docs_of(spark, rows)).collect()
    assert len(got) == 2000
    for s in ("one", "two"):
        some = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in some) - some[0].target) <= 50


def test_empty(spark):
    assert mixing.copies(docs_of(spark, [])).count() == 0 and mixing.mix(docs_of(spark, [])).count() == 0
