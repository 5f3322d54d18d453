import hashlib
import random
import zlib

import numpy as np
import pytest

from marketlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, place string, n string, leaf string, depth string"


def turns_of(spark, rows):
    """Rows (conv_id, turn, role, text), with other columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], SCHEMA)


def plain(rows):
    """Every node by walking the trie of rebuilt conversations."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + seq[h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        parent = min(members[node[:-1]]) if node else None
        last = sorted(c for c in ids if len(built[c]) == len(node))
        out.append((
            min(ids), len(node), parent, len(ids), sum(len(n) == len(node) + 1 for n in below), sum(n not in inner for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, last)).encode()).hexdigest(),
        ))
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(100, 130), 250, 251, *range(-120, -95), 2**62]:
        n = rng.choice([1, 2, 3, 5, 8, 30 if c % 9 == 0 else 4])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("abé🙂") * (t % 3)) for t in range(n)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(12)]  # copies
    rows += [(c, t, "user", "same" if t else "hot") for c in range(400, 420) for t in range(40 + c % 3)]
    rows += [(7, None, None, None), (7, None, "user", ""), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, None, "tie")]
    return rows + [(None, 0, "user", "nobody"), (501, 0, "user", "absent base"), (502, 0, None, None)]


@pytest.mark.parametrize("most", [3, 40, 1 << 16])
def test_trie(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "PACK", 20)
    rows = corpus(most)
    got = prefix_trie.trie(turns_of(spark, rows).repartition(3), most=most)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


def test_no_turns(spark):
    assert prefix_trie.trie(turns_of(spark, [])).count() == 0
    assert prefix_trie.trie(turns_of(spark, [(None, 0, "user", "x")])).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    split = prefix_trie._split
    monkeypatch.setattr(prefix_trie, "_split", lambda *a: rounds.append(1) or split(*a))
    rows = [(0, t, "user", str(t)) for t in range(300)]
    got = prefix_trie.trie(turns_of(spark, rows), most=20).collect()
    assert len(got) == 301 and len(rounds) <= 5
    assert all(r.n_leaves == 1 and r.saved_tokens == 0 and r.n_children == (r.depth < 300) for r in got)
