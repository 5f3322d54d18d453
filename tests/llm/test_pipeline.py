import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from marketlake.llm import minhash_dedup, mixing, sentencepiece_lattice, toxicity
from marketlake.llm._tables import components, running_totals
from marketlake.llm.queries import toxic_held_out
from tests.llm.test_dedup import bag, classes, weighted_jaccard, words
from tests.llm.test_mixing import plain_targets
from tests.llm.test_text import BLANK, PIECES, cheapest

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    found = {m[1] for n in queries() if (m := re.match(r"op(\d+)_", n))}
    assert found == {str(n) for n in range(1, 14)}
    assert "pipeline" in queries()


@pytest.mark.parametrize("name", ["op4_warc", "op6_exact_dedup", "op11_prefix_trie", "op12_divergence"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries()[name](spark, SF)
    want = con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.select(*columns).fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        seen[name] = after
        if name != "sentencepiece":
            assert after.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        docs = after
    n = {k: v.count() for k, v in seen.items()}
    assert 0 < n["minhash_dedup"] <= n["exact_dedup"] <= n["toxicity"] <= before
    assert n["sentencepiece"] == n["mixing"]
    blank = F.regexp_replace("text", r"[\x20\x09-\x0D]", "")
    assert seen["exact_dedup"].select(blank.alias("t")).distinct().count() == n["exact_dedup"]
    assert minhash_dedup.near_duplicates(seen["minhash_dedup"]).where("not kept").count() == 0


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 300), (300, 250)]
    chain += [(500 + i, 400) for i in range(80)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200, 250: 200, 300: 200}
    want |= {400: 400} | {500 + i: 400 for i in range(80)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([(i % 50, i, 1 + i % 3) for i in range(500)], "k int, i int, v long")
    got = sorted(map(tuple, running_totals(df, ["k", "i"], "v", "t", "t").select("k", "i", "v", "t").collect()))
    total = 0
    for k, i, v, t in got:
        assert t == total
        total += v


def plain_mix(rows):
    """How often each of `rows` (doc_id, text, source; different ids, few enough for one block of a class) is taken."""
    size = {d: len(words(t)) for d, t, _ in rows}
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += size[d]
    target = plain_targets(sizes, (1.0, 2.0, 3.0))
    taken, left = {}, {}
    for d, _, s in rows:
        rate = target[s] / sizes[s] if size[d] else 0.0
        taken[d] = int(rate)
        left.setdefault(s, {}).setdefault(math.floor(math.log2(max(size[d], 1)) * 4), []).append((-size[d], str(d), d, rate - int(rate)))
    for by_class in left.values():
        last = []
        for step, some in [*((0, x) for x in by_class.values()), (1, last)]:
            some.sort()
            parts, hand = mixing.pivot([x[1] for x in some], np.array([-x[0] for x in some], float), np.array([x[3] for x in some]), step)
            for k, (n, key, d, _) in enumerate(some):
                if k != hand:
                    taken[d] += int(parts[k])
                elif step:
                    taken[d] += int(parts[k] >= 0.5)
                else:
                    last.append((n, key, d, parts[k]))
    return taken, size, target


def test_run_equals_a_plain_version(spark):
    """All rows of the pipeline, with the scores of toxicity taken as given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxic_held_out)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    assert len(score) == len(rows) and None not in score
    clean = [r for r in rows if score[r[0]] < 0.3]
    best = {}
    for d, t, _ in clean:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
    once = {d for _, d in best.values()}
    single = [r for r in clean if r[0] in once]
    bags = {d: bag(t) for d, t, _ in single}
    total = {d: b.total() for d, b in bags.items()}
    links = [
        (a, b) for a in bags for b in bags
        if a < b and min(total[a], total[b]) >= 0.8 * max(total[a], total[b]) > 0 and weighted_jaccard(bags[a], bags[b]) >= 0.8
    ]
    group = classes(list(bags), links)
    apart = [r for r in single if group[r[0]] == r[0]]
    assert len(apart) < len(single) < len(clean) < len(rows)
    taken, size, target = plain_mix(apart)
    for s in target:
        own = [d for d, _, x in apart if x == s]
        assert abs(sum(taken[d] * size[d] for d in own) - target[s]) <= max(size[d] for d in own) / 2 + 1e-6
    known, of, want = sentencepiece_lattice.pieces(PIECES), {}, Counter()
    for d, t, _ in apart:
        ids = []
        for chunk in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + t.replace(" ", BLANK)) if t else []:
            if chunk not in of:
                of[chunk] = cheapest(chunk, known)
            ids += of[chunk]
        if taken[d]:
            want[d, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), tuple(ids)] += taken[d]
    got = Counter((r.doc_id, r.n_pieces, r.ids_crc32, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
