import random
import re
from collections import Counter, defaultdict

import pytest

from marketlake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string, n string, item string, rank string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source), with other columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], SCHEMA)


def lowered(term):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)


def plain(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [lowered(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)]
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cÉ", "日本", "zz", "Qu") for b in ("x", "yy", "ß", "DD", "İ")]
    rows = []
    for i in range(300):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "é", None, ""])
        words = rng.choices(vocabulary, k=rng.randrange(30), weights=range(1, 26))
        rows.append((i, rng.choice([" ", "7", "\t_", "-"]).join(words), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, None, "en", "s1"), (1, "", "fr", "only"), (2, "rare words here", "it", "a"), (3, "others", "it", "b")]
    return rows + [rows[0]] * 40 + [(5, "AbxabX" * 300 + " Abx", "en", "s2"), (6, "Abx " * 4000, "de", "s9")]


@pytest.mark.parametrize("entries,piece", [(40, 7), (10**6, 1 << 14)])
def test_audit(spark, monkeypatch, entries, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    monkeypatch.setattr(divergence, "CHUNK", 64)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    rows = corpus()
    got = divergence.audit(docs_of(spark, rows).repartition(5), least=10, top=4, entries=entries)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 10, 4))


def test_terms_do_not_depend_on_stretches(monkeypatch):
    texts = ["a b", "", "x" * 200, "x" * 64 + " y", "Ünï çode " * 30, "ab" * 31 + " " + "c" * 70 + " d"]
    whole = [[w for part in divergence.terms_of(t.encode()) for w in part] for t in texts]
    for size in (5, 64):
        monkeypatch.setattr(divergence, "CHUNK", size)
        assert [[w for part in divergence.terms_of(t.encode()) for w in part] for t in texts] == whole


def test_large_counts_are_exact(spark):
    n = 10**13
    df = spark.createDataFrame([(n - 1, n, 7), (0, 3, 0), (0, 0, 0)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(df.c, df.n, df.v)).collect()]
    assert got == [1 + 10**9 * (n + 1) // (n + 14), 1 + 2 * 10**9 // 3, None]


def test_no_rows(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0
