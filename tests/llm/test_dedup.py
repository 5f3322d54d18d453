import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.llm import embedding_dedup, exact_dedup, minhash_dedup, substring_dedup
from marketlake.llm._words import PRIME, WORD_BASE, lanes, mix, prime_runs, split, text_groups
from marketlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, content string, size int, id string, component string"


def docs_of(spark, rows):
    """Rows (doc_id, text), with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def classes(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


ODD = ["", None, " \t\n\x0b\x0c\r", "a", "a  b", "ab", "é\x1cß 　 x", "日本語 " * 50, "word " * 30000]


def test_words_kernel():
    import pyarrow as pa

    texts = [*ODD, "x" * 5_000_000, *("t%d u" % i for i in range(500))]
    of = {}
    for i, j, data, offsets in text_groups(pa.array(texts)):
        starts, ends, h = split(data)
        first = np.searchsorted(starts, offsets)
        for k in range(j - i):
            own = slice(first[k], first[k + 1])
            got = [data[s:e].tobytes().decode() for s, e in zip(starts[own], ends[own])]
            assert got == words(texts[i + k])
            for w, x in zip(got, h[own].tolist()):
                assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_exact(spark):
    rows = list(enumerate([*ODD, "a b", "a\tb c", "abc", " abc ", "abc"])) + [(None, "a b"), (None, "only here"), (9, "abc")]
    docs = docs_of(spark, rows)
    got = sorted(map(tuple, exact_dedup.exact_groups(docs, salts=3).collect()), key=str)
    keys = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    want = []
    for (doc_id, _), key in zip(rows, keys):
        same = [(-len(t or ""), d) for (d, t), k in zip(rows, keys) if k == key]
        best = min((s for s in same if s[1] is not None), default=(0, None))[1]
        kept = best is None or doc_id == best
        want.append((doc_id, best, len(same), kept, hashlib.sha256(key.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert Counter(texts) == Counter(set(keys))
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0


def test_exact_needs_no_python(spark):
    plan = QUERIES["op6_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def corpus():
    """Texts that share passages with each other and with themselves."""
    rng = np.random.default_rng(1)
    passage = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(4)]
    rows = []
    for i in range(120):
        own = [f"d{i}w{j}" for j in range(int(rng.integers(0, 90)))]
        at = int(rng.integers(0, len(own) + 1))
        mid = [passage[rng.integers(4)] for _ in range(int(rng.integers(0, 3)))]
        rows.append((i, "\n".join([" ".join(own[:at]), *mid, " ".join(own[at:])])))
    texts = [*ODD, "w " * 34, "v " * 35, "u " * 36, passage[0], passage[0]]
    return rows + list(enumerate(texts, 1000)) + [(None, passage[1]), (7, rows[7][1]), (7, "another text under one id " + passage[2])]


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH", 500)  # several batches, so that buckets have work to do
    rows = corpus()
    seen = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for doc_id, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        left = [x for x, k in zip(w, keep) if k]
        want.append((doc_id, len(w), len(w) - len(left), " ".join(left)))
    got = substring_dedup.remove_repeats(docs_of(spark, rows).repartition(3, "doc_id"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def thue_morse(n, a="a", b="b"):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_words_of_one_polynomial_are_told_apart(spark):
    """The two words have one hash as a polynomial modulo 2**64, whatever its base."""
    shared = " ".join(f"w{i}" for i in range(34))
    one, two = "".join(thue_morse(2048)), "".join(thue_morse(2048, "b", "a"))
    got = substring_dedup.remove_repeats(docs_of(spark, [(1, f"{one} {shared}"), (2, f"{two} {shared}")])).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(35, 0)] * 2
    short = ["".join(thue_morse(n, x, y)) for n in (8, 16, 32, 64, 128) for x, y in (("a", "b"), ("b", "a"))]
    import pyarrow as pa

    for _, _, data, _ in text_groups(pa.array([" ".join(short)])):
        assert len(set(split(data, hashed=lanes)[2].tolist())) == len(short)


def test_runs_are_polynomials_modulo_the_prime():
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h[:3] = [0, 2**61 - 1, 2**64 - 1]
    for size in (1, 5, 35, 4999):
        got = prime_runs(h, size)
        base = WORD_BASE % PRIME
        for i in {0, 1, min(17, len(h) - size), len(h) - size}:
            plain = sum(int(x) * pow(base, j, PRIME) for j, x in enumerate(h[i : i + size])) % PRIME
            assert mix(np.array([plain], np.uint64))[0] == got[i]
    words = np.array([11, 29], np.uint64)
    order = [np.array([i.bit_count() % 2 ^ flip for i in range(2048)]) for flip in (0, 1)]
    assert prime_runs(words[order[0]], 2048)[0] != prime_runs(words[order[1]], 2048)[0]


def bag(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def weighted_jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = {int(rng.integers(1, 2**63)): int(rng.integers(1, 40)) for _ in range(300)}
    b = {k: max(1, v + int(rng.integers(-9, 9))) for k, v in list(a.items())[:240]}
    both = [Counter(a), Counter(b)]
    text = np.repeat([0, 1], [len(a), len(b)])
    hashes = np.array([*a, *b], np.uint64)
    weights = np.array([*a.values(), *b.values()])
    s = minhash_dedup.signatures(text, hashes, weights, 2, 20000)
    assert (s[0] == s[1]).mean() == pytest.approx(weighted_jaccard(*both), abs=0.015)


def near_corpus():
    rng = np.random.default_rng(5)
    rows = []
    for base in range(12):
        own = [f"b{base}x{i}" for i in range(int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(own)
            for _ in range(int(rng.integers(0, 4))):
                copy[rng.integers(len(copy))] = f"n{rng.integers(1000)}"
            rows.append(" ".join(copy))
    rows += [*ODD, "", "a b c", "a b c", "a b c d", "r " * 500, "r " * 550, "r " * 100]
    return list(enumerate(rows))


def test_near(spark):
    rows = near_corpus()
    docs = docs_of(spark, [*rows, (None, rows[0][1])])
    bags = {d: bag(t) for d, t in rows}
    links = [(a, b) for a in bags for b in bags if a < b and weighted_jaccard(bags[a], bags[b]) >= 0.8]
    want = classes(bags, links)
    assert len(set(want.values())) < len(want) - 20
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got.pop(None) == (None, True)
    assert got == {d: (c, c == d) for d, c in want.items()}
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values())) + 1
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_a_bucket_without_a_hub_that_links(spark):
    """Candidates that do not link to the smallest of their bucket still find each other."""
    base = [f"w{i}" for i in range(400)]
    first = base[:320] + [f"a{i}" for i in range(80)]
    others = [base[:398] + [f"o{k}", f"p{k}"] for k in range(6)]
    rows = [(0, " ".join(first)), *((k + 1, " ".join(o)) for k, o in enumerate(others))]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {0: 0} | {k: 1 for k in range(1, 7)}


def vectors_of(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, shard string, block string, width string"
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((centre + rng.normal(size=16) * rng.choice([0.02, 0.05, 0.3]), int(c % 2)))
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * 0.01, 1) for _ in range(300)]
    rows = [(i, [float(np.float32(v)) for v in x], label) for i, (x, label) in enumerate(rows)]
    n = len(rows)
    same = rows[0][1]
    odd = [None, [], [0.0] * 16, [None] + same[1:], [float("nan")] + same[1:], [float("inf")] + same[1:]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 10, same, None), (n + 11, same[:8], 0), (n + 12, [v * 1e-30 for v in same], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors_of(spark, rows), shard=64, block=50).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if k is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.abs(v).max() for _, v, _ in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    links = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(np.triu(cos >= 0.98, 1))) if good[a][2] == good[b][2]]
    count = Counter(x for pair in links for x in pair)
    want = classes([i for i, _, _ in rows], links)
    assert len(links) > 20000
    found = sum(r.n_links for r in got.values())
    assert found >= 0.999 * 2 * len(links) and all(got[i].n_links <= count[i] for i in got)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0


def test_recall_is_measured(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 12))
    x[::3] = x[0] + rng.normal(size=(300, 12)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(x)
    a, b, recall = embedding_dedup.linked(graph, x, 0.98)
    truth = set(zip(*np.nonzero(x @ x.T >= 0.98)))
    assert recall >= 0.9 and len(truth & set(zip(a, b))) >= 0.99 * len(truth)
    ids, _ = graph.search(x[:200], 64)
    nearest = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(i) & set(t)) / 10 for i, t in zip(ids[:, :10].tolist(), nearest.tolist())]) >= 0.9


def pairs_of(rng, n, pairs, width=32):
    """Vectors that link to nothing but, for some, one other."""
    x = rng.normal(size=(n, width))
    x[n - pairs :] = x[:pairs] + rng.normal(size=(pairs, width)) * 0.05
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_an_audit_needs_links(spark):
    """Links that a graph cannot reach are found though few queries have any, and a vector's link to itself is no evidence."""
    x = pairs_of(np.random.default_rng(11), 1000, 0)
    first, second = np.arange(1, 21), np.arange(970, 990)
    x[second] = x[first] + np.random.default_rng(13).normal(size=(20, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(x)
    for table in graph.links:
        table[np.isin(table, second)] = -1  # nothing leads to the second of each pair
    truth = set(zip(first.tolist(), second.tolist())) | set(zip(second.tolist(), first.tolist()))
    a, b, recall = embedding_dedup.linked(graph, x, 0.98, own=np.arange(1000))
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i != j} == truth
    assert recall <= 0.5


def test_sparse_pairs_of_a_large_label(spark):
    """A label of several shards of the usual size: every pair is found from both sides."""
    n, pairs = 9000, 300
    x = pairs_of(np.random.default_rng(12), n, pairs).astype(np.float32)
    frame = vectors_of(spark, [(i, v, 0) for i, v in enumerate(x.tolist())])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j + i + 1) for i in range(n) for j in np.flatnonzero(unit[i + 1 :] @ unit[i] >= 0.98).tolist()]
    assert len(links) >= 0.9 * pairs
    count = Counter(i for pair in links for i in pair)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: count[i] for i in range(n)}
    assert {i: r.component_id for i, r in got.items()} == classes(list(range(n)), links)
    seen = embedding_dedup.search_links(frame).agg(F.sum("audited").alias("links"), F.sum("hits").alias("hits")).first()
    assert seen.links == 2 * len(links) and seen.hits >= 0.95 * seen.links
    scans = embedding_dedup.search_links(frame).agg(F.sum("scanned").alias("scanned"), F.sum("queries").alias("queries")).first()
    assert scans.queries == 3 * n and scans.scanned <= 0.1 * scans.queries


def test_a_miss_widens_the_beam(monkeypatch):
    """Where a thin graph misses links, audits are drawn anew with wider beams, at last as wide as the shard."""
    n = 3000
    x = pairs_of(np.random.default_rng(15), n, 600)
    truth = x @ x.T >= 0.98
    graph, asked = embedding_dedup.Graph(x), []
    search = embedding_dedup._searched
    monkeypatch.setattr(embedding_dedup, "_searched", lambda g, q, t, beam: asked.append((beam, len(q))) or search(g, q, t, beam))
    found, links, hits, scanned = embedding_dedup.audited(graph, x, 0.98, np.arange(n))
    assert (found == truth).all() and links == hits and scanned <= 0.1 * n and asked == [(embedding_dedup.BEAM, n)]
    asked.clear()
    graph.links[0][:, 6:] = -1
    found, links, hits, scanned = embedding_dedup.audited(graph, x, 0.98, np.arange(n), beam=4)
    assert [beam for beam, _ in asked] == [4, 16, 64, 256] and asked[1][1] < n
    assert hits < links and scanned == n and (found == truth).all()
