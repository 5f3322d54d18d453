import hashlib
import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import quality, sentencepiece_lattice, token_codes, toxicity, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BLANK = "▁"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " \t\n\x0b\x0c\r", "a", "a  b", "\n\n x", "é\x1cß 　 x", "日本語 " * 50, "x" * 3000, "Word. word, WORD 'S it's İ, Σ. <|endoftext|>"]


def docs_of(spark, rows):
    """Rows (doc_id, text), with other columns whose names the operators use themselves."""
    schema = "doc_id long, text string, block string, score string, ids string, mark string"
    return spark.createDataFrame([(*r, "x", "y", "z", "m") for r in rows], schema)


# WARC


def pages_of(spark, rows):
    schema = "page_id long, url string, html string, digest string, size string, response string"
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)


def test_warc_round_trip(spark):
    long = "é" * 600
    pages = [(1, "http://a", long), (2, None, long), (3, "http://b x\n", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "")]
    pages += [(None, "u", long), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90), (9, "u", "z" * 1000), (9, "u", "z" * 1000), (10, "u", "q" * 200_000)]
    index = warc.write(pages_of(spark, pages), frame=2000, bundle=300)
    assert index.count() == len(pages) and index.select("bundle").distinct().count() > 1
    got = warc.read(index).collect()
    want = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        other = max(same) if len(data) >= 1000 and page_id != max(same) else None
        kind = "response" if other is None else "revisit"
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), kind, other, data if other is None else None))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in got]
    clean = [(*r[:5], r[5] or None) for r in rows]
    assert sorted(clean, key=str) == sorted([(*r[:5], r[5] or None) for r in want], key=str)
    one = warc.look_up(index, F.col("page_id") == 10).collect()
    assert [bytes(r.payload) for r in one] == [b"q" * 200_000]
    assert warc.read(warc.write(pages_of(spark, []))).count() == 0


def test_bundles_are_seekable_zstandard(spark):
    index = warc.write(pages_of(spark, [(i, "u", f"{i} " * 500) for i in range(20)]).coalesce(1), frame=3000)
    uri = index.first().bundle
    with open(uri.removeprefix("file:"), "rb") as f:
        data = f.read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 20
    table = warc.frames(len(data), lambda n: data[-n:])
    assert len(table) > 3 and sum(n for _, _, n in table) == len(whole)
    at, packed, n = table[2]
    assert len(zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=n)) == n
    with pytest.raises(ValueError):
        warc.frames(10, lambda n: b"\0" * n)


# Token codes


@pytest.mark.parametrize("width", [5, 8, 10, 16, 20])
def test_codes(width):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 70000, 4000).astype(np.uint32)
    ids[::7], ids[5] = rng.integers(0, 30, len(ids[::7])), 2**32 - 1
    codes = token_codes.Codes(token_codes.pack([(4, ids[:9]), (None, ids[9:9]), (5, ids[9:])], width))
    assert codes.docs == [(4, 0, 9), (None, 9, 0), (5, 9, 3991)]
    assert [codes.token(i) for i in range(0, 4000, 13)] == ids[::13].tolist()
    for first in range(0, 4000, 331):
        for last in (first, first + 1, min(4000, first + 700)):
            assert codes.tokens(first, last).tolist() == ids[first:last].tolist()
    assert token_codes.Codes(token_codes.pack([])).docs == []


def test_words_are_encoded_as_in_their_texts():
    rng = np.random.default_rng(2)
    letters = [*"aAbzé ÉΣςσß.,'’sS09́क़  \x1c\x85中İ\n\t", "<|endoftext|>", "'s", "ǅ.", "ſ,", "Σ.", "ΑΣ,"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    plain = Tokenizer.from_file(WORD_BPE)
    for text, ids in zip(texts, token_codes.encode_texts([t.encode() for t in texts], token_codes.Words(WORD_BPE, most=100))):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files(spark):
    rows = list(enumerate(ODD, 5)) + [(None, "no id"), (5, "again"), (-3, "first " * 2000), (5, "again")]
    plain = Tokenizer.from_file(WORD_BPE)
    manifest = token_codes.write(docs_of(spark, rows), WORD_BPE, file=1000)
    got = token_codes.read(manifest).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    start, found = 0, []
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
        found.append((r.doc_id, tuple(r.ids)))
    want = [(d, (*plain.encode(t or "", add_special_tokens=False).ids, 2)) for d, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert token_codes.read(token_codes.write(docs_of(spark, []), WORD_BPE)).count() == 0


# SentencePiece


def cheapest(text, known):
    """The best path of a whole text: by cost, number of pieces, and last piece."""
    number = {p: k for k, (p, _, _) in enumerate(known.table)}
    paths = [(0, 0, 0, ())]
    for end in range(1, len(text) + 1):
        here = []
        for begin in range(max(0, end - known.longest), end):
            piece, (cost, n, _, ids) = text[begin:end], paths[begin]
            if piece in number:
                k = number[piece]
                here.append((cost + known.table[k][1], n + 1, k, ids + known.table[k][2]))
            elif end == begin + 1:
                here.append((cost + 10**6, n + 1, 0, ids + known.bytes_of(piece)))
        paths.append(min(here, key=lambda x: x[:3]))
    return list(paths[-1][3])


def test_sentencepiece(spark):
    more = [" a", "   leading and   many    blanks ", "naïve 🙂 tokens\n\ttab", "internationalization " * 20, "▁ a▁b"]
    rows = list(enumerate([*ODD, *more])) + [(3, "a"), (None, "b")]
    encoded = sentencepiece_lattice.encode(docs_of(spark, rows), PIECES)
    known = sentencepiece_lattice.pieces(PIECES)
    want = []
    for doc_id, text in rows:
        whole = BLANK + text.replace(" ", BLANK) if text else ""
        ids = cheapest(whole, known)
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), ids))
    assert sorted(map(tuple, encoded.collect()), key=str) == sorted(want, key=str)
    texts = [(r.doc_id, r.text) for r in sentencepiece_lattice.decode(encoded, PIECES).collect()]
    assert sorted(texts, key=str) == sorted([(d, (t or "").replace(BLANK, " ")) for d, t in rows], key=str)
    assert sentencepiece_lattice.encode(docs_of(spark, []), PIECES).count() == 0


def test_long_units_are_whole(spark):
    """Runs without blanks get the cheapest path of the whole text, also across 64, 128, ... characters."""
    rng = np.random.default_rng(5)
    words = "information because people thought through government another different important company system against".split()
    texts = ["".join(rng.choice(words, 10)) for _ in range(40)]
    texts += ["x" * n for n in (62, 63, 64, 65, 127, 128, 3000)] + ["internationalization" * 30 + " a " + "".join(words), "日本語" * 60 + "".join(words)]
    known = sentencepiece_lattice.pieces(PIECES)
    got = {r.doc_id: list(r.ids) for r in sentencepiece_lattice.encode(docs_of(spark, list(enumerate(texts))), PIECES).collect()}
    assert got == {i: cheapest(BLANK + t.replace(" ", BLANK), known) for i, t in enumerate(texts)}


def test_blocks_hold_different_chunks_only(monkeypatch):
    """What Arrow holds from one packed part of a block to the next does not grow with the texts, only with their chunks."""
    known, n = sentencepiece_lattice.pieces(PIECES), 20
    texts = [" ".join(f"sphinxofblackquartz{i % 500}" for i in range(10_000)).encode()] * n
    rows = [(0, [d], [len(t)], zstandard.compress(t)) for d, t in enumerate(texts)]
    kinds = [("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("texts", pa.binary())]
    batch = pa.record_batch([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
    held, split = [], sentencepiece_lattice._split

    def counted(*x):
        held.append(pa.total_allocated_bytes())
        return split(*x)

    class Shared:
        value = known

    monkeypatch.setattr(sentencepiece_lattice, "_split", counted)
    assert list(sentencepiece_lattice._ask(Shared, 1)(iter([batch])))[0].num_rows == 1
    none = pa.table({"bucket": pa.array([], pa.int32()), "sizes": pa.array([], pa.list_(pa.int8())), "path": pa.array([], pa.list_(pa.int32()))})
    with pytest.raises(ValueError, match="and got 0"):
        sentencepiece_lattice._assemble(Shared, 1)(pa.Table.from_batches([batch]), none)
    assert len(held) == 2 * n
    for part in (held[:n], held[n:]):
        assert max(part) - part[0] < sum(map(len, texts)) / 3


def test_units_are_dealt_as_columns():
    """No call for each chunk or unit, whether units are made of chunks or dealt to buckets by their hashes."""
    known, calls = sentencepiece_lattice.pieces(PIECES), Counter()
    letters = np.random.default_rng(7).choice(list("etaoinshré"), (5000, 9))
    some = pa.array(sorted({"".join(x) for x in letters}), pa.large_string())
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        every, numbers, counts = known.different_units(some)
        at, of = sentencepiece_lattice._shares(every, 7)
    finally:
        sys.setprofile(None)
    assert sum(calls.values()) < 1000
    texts = every.take(pa.array(numbers)).to_pylist()
    ends = np.cumsum(counts).tolist()
    assert ["".join(texts[x:y]) for x, y in zip([0, *ends], ends)] == [BLANK + x for x in some.to_pylist()]
    assert sorted(at.tolist()) == [i for i, u in enumerate(every.to_pylist()) if len(u) > 1]
    assert (np.diff(of) >= 0).all() and len(set(of.tolist())) == 7


def test_lattice(spark):
    """Edges are joined by one number, not by text, and Viterbi over all units at once finds each one's cheapest path."""
    known = sentencepiece_lattice.pieces(PIECES)
    rng = np.random.default_rng(6)
    texts = {"".join(rng.choice(list("etaoinshr"), n)) for n in rng.integers(2, 64, 300)}
    texts |= {"ti", "internationalization", "x" * 63, "日本語日本"}
    units = sorted(u for u in known.different_units(pa.array(sorted(texts), pa.large_string()))[0].to_pylist() if len(u) > 1)
    found = sentencepiece_lattice.lattice(spark.createDataFrame([(0, u) for u in units], "bucket int, unit string").distinct(), known)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(piece" in plan and "lambda" not in plan
    rows = found.collect()
    assert sorted(r.unit for r in rows) == units and {r.bucket for r in rows} == {0}
    edges = sentencepiece_lattice.Ragged(np.array([e for r in rows for e in r.edges], np.int32), np.array([len(r.edges) for r in rows]))
    paths = sentencepiece_lattice._cheapest(pa.array([r.unit for r in rows]), edges, known)
    ends = np.cumsum(paths.sizes).tolist()
    for r, x, y in zip(rows, [0, *ends], ends):
        assert [i for k in paths.values[x:y].tolist() for i in known.table[k][2]] == cheapest(r.unit, known)
    nothing = sentencepiece_lattice._cheapest(pa.array([], pa.string()), sentencepiece_lattice.Ragged(np.empty(0, np.int32), np.empty(0, np.int64)), known)
    assert not len(nothing.values) and not len(nothing.sizes)


def test_units_make_up_the_text():
    known = sentencepiece_lattice.pieces(PIECES)
    for text in [*ODD, " a  b c   "]:
        some = sentencepiece_lattice.chunks(text)
        every, counts = known.units(some)
        joined = "".join(every)
        assert len(counts) == len(some) and counts.sum() == len(every)
        assert joined == (BLANK + text.replace(" ", BLANK) if text else "")


# Scores


def held_out(doc_id):
    return F.coalesce(doc_id % 5 == 0, F.lit(False))


def labelled(spark, bad_word):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, rng.integers(20, 60)))
        bad = i % 3 == 0
        if bad:
            for k in range(3):
                text.insert(int(rng.integers(len(text))), f"{bad_word}{rng.integers(9)}")
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad), 1 - int(bad)))
    docs += [(1000, None), (1001, ""), (None, "no id"), (5, docs[5][1]), (1002, "w1 " * 20000)]
    labels += [(None, 1, 1), (1001, None, None), (3, 1, 0)]
    return docs_of(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), docs


@pytest.mark.parametrize("module, label, sign", [(toxicity, "toxic", 1), (quality, "quality", -1)])
def test_scores(spark, module, label, sign):
    docs, labels, rows = labelled(spark, "vile")
    model = module.train(docs, labels, held_out, label)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert module.score(docs, model).count() == len(rows)
    assert all(0 <= s <= 1 for s in got.values())
    test = [(got[i], i % 3 == 0) for i in range(0, 600, 5)]
    right = sum((s >= 0.3) == (bad if sign > 0 else not bad) for s, bad in test)
    assert right >= 0.9 * len(test)
    assert got[1000] == got[1001]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_without_labels(spark, module):
    docs, labels, rows = labelled(spark, "vile")
    for some in (labels.where("false"), labels.where("toxic = 1")):
        model = module.train(docs, some, held_out)
        assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    model = module.train(docs, labels, held_out)
    assert module.score(docs.where("false"), model).count() == 0


def test_toxic_rows_go(spark):
    docs, labels, rows = labelled(spark, "vile")
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels, held_out))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum(i is not None and i < 600 and i % 3 == 0 for i in ids) < 20 and len(ids) > 390


def brute_segments(scores, shift=0):
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate(([0], np.cumsum(scores)))
    best = max((total[j] - total[i], i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    i, j = best[3:]
    return brute_segments(scores[:i], shift) + [(shift + i, shift + j)] + brute_segments(scores[j:], shift + j)


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(500):
        scores = rng.integers(-4, 4, rng.integers(0, 18)) + rng.random() * 0.01
        assert [x[:2] for x in toxicity.segments(scores)] == brute_segments(scores)
    falling = np.tile([1.0, -2.0], 200_000)  # many segments, each lower than the last
    assert len(toxicity.segments(falling)) == 200_000


def test_the_law_of_clean_texts():
    rng = np.random.default_rng(6)
    n = rng.integers(10, 3000, 20000)
    best = 2.0 + 0.8 * np.log(n) + 0.5 * rng.gumbel(size=len(n))
    law = toxicity.fit_law(best, n)
    p = toxicity.significance(best, n, law)
    assert (p <= 0.01).mean() == pytest.approx(0.01, abs=0.004) and (p <= 0.5).mean() == pytest.approx(0.5, abs=0.03)


def test_features_see_whole_texts():
    texts = ["a b " * 50000 + "unlike", "a b " * 50000, "", "x"]
    counts = []
    for i, j, data, offsets in quality.text_groups(pa.array(texts)):
        t, f = quality.features(data, offsets)
        counts += np.bincount(t, minlength=j - i).tolist()
    assert counts[0] > counts[1] and counts[2] > 0


def test_the_quality_model_equals_a_plain_one(monkeypatch):
    """Log-count ratios and dual coordinate descent on dictionaries, one number at a time."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: 40 - 20 * (i % 3 == 0)], rng.integers(1, 30))).encode() for i in range(40)] + [b""]
    labels = np.array([int(i % 3 > 0) for i in range(41)])
    model = quality.fit(texts, labels, seed=3)
    sets = []
    for t in texts:
        _, f = quality.features(np.frombuffer(t + b"\n", np.uint8), np.array([0, len(t) + 1]))
        sets.append(sorted(set(f.tolist())))
    y = [1.0 if k else -1.0 for k in labels]
    size = 1 << quality.BITS
    count = {s: Counter(f for x, k in zip(sets, y) if k == s for f in x) for s in (1.0, -1.0)}
    total = {s: sum(count[s].values()) + quality.ALPHA * size for s in count}
    ratio = {f: math.log((count[1.0][f] + quality.ALPHA) / total[1.0]) - math.log((count[-1.0][f] + quality.ALPHA) / total[-1.0]) for x in sets for f in x}

    def descend(rows):
        w, alpha, order = Counter(), [0.0] * len(y), np.random.default_rng(3)
        most = {s: quality.COST * len(rows) / (2 * max(1, sum(y[i] == s for i in rows))) for s in (1.0, -1.0)}
        for _ in range(quality.PASSES):
            for i in order.permutation(rows):
                x = {f: ratio[f] / math.sqrt(max(1, len(sets[i]))) for f in sets[i]}
                slope = y[i] * sum(w[f] * v for f, v in x.items()) - 1
                new = min(max(alpha[i] - slope / max(sum(v * v for v in x.values()), 1e-12), 0.0), most[y[i]])
                for f, v in x.items():
                    w[f] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        mean = sum(map(abs, w.values())) / max(1, sum(v != 0 for v in w.values()))
        return lambda f: (quality.SHARE * w[f] + (1 - quality.SHARE) * mean) * ratio[f]

    def margin(i, weight):
        return sum(map(weight, sets[i])) / math.sqrt(max(1, len(sets[i])))

    every = descend(np.arange(len(y)))
    assert {f: model["weights"][f] for f in ratio} == pytest.approx({f: every(f) for f in ratio}, rel=1e-4, abs=1e-5)
    fold = np.random.default_rng(3).permutation(len(y)) % 2
    margins = np.zeros(len(y))
    for k in (0, 1):
        weight = descend(np.flatnonzero(fold != k))
        margins[fold == k] = [margin(i, weight) for i in np.flatnonzero(fold == k)]
    # The scale is where the weighted log loss and its penalty have no slope.
    spread, share = margins.std(), {s: 0.5 / y.count(s) for s in (1.0, -1.0)}
    p = [1 / (1 + math.exp(-(model["a"] * m + model["b"]))) for m in margins]
    off = [share[k] * (v - (k > 0)) for k, v in zip(y, p)]
    assert model["a"] > 0 and sum(off) == pytest.approx(0, abs=1e-5)
    assert sum(o * m / spread for o, m in zip(off, margins)) + 1e-3 * model["a"] * spread == pytest.approx(0, abs=1e-5)
