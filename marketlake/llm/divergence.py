"""How far apart sources are in their use of words: an inverted index in blocks, and exact sums over it.

Each task indexes its documents in memory: for a language the number of documents of each term, for a source the occurrences of each term.
When the block is full it is spilled as a run in order of term, cut by hash shard. A shard merges its runs with a heap, in order of term,
and holds one open piece of each run. What comes out are the frequencies of the terms that enough documents have.

Sums over all terms for a pair of sources never visit terms that neither has. With f0 for a term that both lack, the sum is V * f0, plus for
each source what its own terms change against the other's value for absent terms (by its distinct values, in blocks of sources), plus
corrections for the terms that both have. The corrections are streamed from the postings and added up by pair inside each task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm._tables import shuffle_partitions, stored

LEAST = 10
TOP = 10
#: Entries of a block in memory before it is spilled.
ENTRIES = 400_000
#: Postings of one piece of a run.
PIECE = 16_384
#: Sources compared at once with the values of one.
BLOCK = 256
#: Bytes of a text worked on at once.
CHUNK = 1 << 20

_RUN = "shard int, first binary, keys array<binary>, docs binary, sizes binary, sources array<string>, places binary, counts binary"
_TERMS = "lang string, term string, sources array<string>, counts array<bigint>"
_PAIRS = "lang string, source string, other string, value bigint"

#: ASCII letters in lower case; all other ASCII is a blank. Bytes above belong to letters of other scripts.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each stretch of it."""
    at = 0
    while at < len(text):
        part = text[at : at + CHUNK].translate(_LOWER)
        end = len(part) if at + CHUNK >= len(text) else part.rfind(b" ") + 1
        if not end:  # no blank in sight: up to the next one
            rest = text[at + CHUNK :].translate(_LOWER)
            more = rest.find(b" ")
            part += rest if more < 0 else rest[:more]
            end = len(part)
        yield part[:end].split()
        at += end


class Block:
    """Postings in memory: documents by language and term, occurrences by language, source and term."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = {}
        self.counts: dict[tuple[str, str], Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        docs, counts = self.docs.setdefault(lang, Counter()), self.counts.setdefault((lang, source), Counter())
        before = len(docs) + len(counts)
        seen: set[bytes] = set()
        for words in terms_of(text):
            counts.update(words)
            seen.update(words)
        docs.update(seen)
        self.entries += len(docs) + len(counts) - before

    def run(self, shards: int) -> Iterator[tuple]:
        """The block in order of shard, language and term, in pieces."""
        names = sorted({s for _, s in self.counts})
        number = {s: i for i, s in enumerate(names)}
        keys, docs, at, places, counts = [], [], [], [], []
        for lang in sorted(self.docs):
            prefix = lang.encode() + b"\0"
            terms = sorted(self.docs[lang])
            rank = dict(zip(terms, range(len(keys), len(keys) + len(terms))))
            keys += [prefix + t for t in terms]
            docs.append(np.fromiter(map(self.docs[lang].__getitem__, terms), np.int64, len(terms)))
            for (where, source), c in self.counts.items():
                if where == lang:
                    at.append(np.fromiter(map(rank.__getitem__, c), np.int64, len(c)))
                    places.append(np.full(len(c), number[source], np.int32))
                    counts.append(np.fromiter(c.values(), np.int64, len(c)))
        if not keys:
            return
        docs, at, places, counts = (np.concatenate(x) for x in (docs, at, places, counts))
        shard = np.fromiter((zlib.crc32(k) % shards for k in keys), np.int32, len(keys))
        order = np.argsort(shard, kind="stable")  # keys are in order within each shard
        turn = np.empty(len(keys), np.int64)
        turn[order] = np.arange(len(keys))
        by_term = np.lexsort((places, turn[at]))
        places, counts = places[by_term], counts[by_term]
        sizes = np.bincount(turn[at], minlength=len(keys))
        ends = np.cumsum(sizes)
        shard, docs = shard[order], docs[order]
        edges = np.append(np.flatnonzero(np.diff(shard)) + 1, len(keys))
        i = 0
        for edge in edges.tolist():
            while i < edge:
                first = int(ends[i] - sizes[i])
                j = min(edge, max(i + 1, int(np.searchsorted(ends, first + PIECE, side="right"))))
                used, own = np.unique(places[first : ends[j - 1]], return_inverse=True)
                piece = [keys[k] for k in order[i:j].tolist()]
                yield (
                    int(shard[i]), piece[0], piece, docs[i:j].tobytes(), sizes[i:j].astype(np.int32).tobytes(),
                    [names[u] for u in used.tolist()], own.astype(np.int32).tobytes(), counts[first : ends[j - 1]].tobytes(),
                )
                i = j


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_RUN_ARROW = pa.schema(
    [("shard", pa.int32()), ("first", pa.binary()), ("keys", pa.list_(pa.binary())), ("docs", pa.binary()), ("sizes", pa.binary()),
     ("sources", pa.list_(pa.string())), ("places", pa.binary()), ("counts", pa.binary())]
)
_TERMS_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PAIRS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])


def _index(shards: int, entries: int):
    def spilled(block: Block) -> Iterator[pa.RecordBatch]:
        out = []
        for row in block.run(shards):
            out.append(row)
            if len(out) == 64:
                yield _rows(out, _RUN_ARROW)
                out = []
        if out:
            yield _rows(out, _RUN_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = b.column(2).cast(pa.large_binary())
            for i in range(len(b)):
                block.add(langs[i], sources[i], texts[i].as_py())
                if block.entries >= entries:
                    yield from spilled(block)
                    block = Block()
        yield from spilled(block)

    return run


class _Piece:
    """One piece of a run, open at its next term."""

    def __init__(self, row: dict, number: dict[str, int]) -> None:
        self.keys, self.at = row["keys"], 0
        self.docs = np.frombuffer(row["docs"], np.int64).tolist()
        self.ends = [0, *np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()]
        own = np.array([number.setdefault(s, len(number)) for s in row["sources"]], np.int64)
        self.places = own[np.frombuffer(row["places"], np.int32)]
        self.counts = np.frombuffer(row["counts"], np.int64)


def _merge(least: int):
    """Pieces in order of their first key into the frequencies of the keys with enough documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        heap: list[tuple[bytes, int, _Piece]] = []
        kept: list[bytes] = []
        which, places, counts = [], [], []
        held = pieces = 0

        def taken() -> None:
            nonlocal held
            key, docs, parts = heap[0][0], 0, []
            while heap and heap[0][0] == key:
                _, n, piece = heap[0]
                docs += piece.docs[piece.at]
                parts.append((piece, piece.ends[piece.at], piece.ends[piece.at + 1]))
                piece.at += 1
                if piece.at < len(piece.keys):
                    heapq.heapreplace(heap, (piece.keys[piece.at], n, piece))
                else:
                    heapq.heappop(heap)
            if docs >= least:
                for piece, i, j in parts:
                    which.append(np.full(j - i, len(kept)))
                    places.append(piece.places[i:j])
                    counts.append(piece.counts[i:j])
                    held += j - i
                kept.append(key)

        def flushed() -> pa.RecordBatch:
            nonlocal held
            code = np.concatenate(which) * len(number) + np.concatenate(places)
            distinct, back = np.unique(code, return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, back, np.concatenate(counts))
            names = pa.array(list(number), pa.string())
            offsets = np.searchsorted(distinct // len(number), np.arange(len(kept) + 1)).astype(np.int32)
            langs, terms = zip(*(k.rsplit(b"\0", 1) for k in kept), strict=True)
            out = pa.record_batch(
                [
                    pa.array(langs, pa.binary()).cast(pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(distinct % len(number)))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums)),
                ],
                schema=_TERMS_ARROW,
            )
            for x in (kept, which, places, counts):
                x.clear()
            held = 0
            return out

        for b in batches:
            for row in b.to_pylist():
                while heap and heap[0][0] < row["first"]:
                    taken()
                    if held >= 1 << 18:
                        yield flushed()
                heapq.heappush(heap, (row["first"], pieces, _Piece(row, number)))
                pieces += 1
        while heap:
            taken()
            if held >= 1 << 18:
                yield flushed()
        if kept:
            yield flushed()

    return run


def grouped(docs: DataFrame) -> DataFrame:
    """`lang`, `source` and `text` of `docs`, '' for null."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def frequencies(docs: DataFrame, least: int = LEAST, entries: int = ENTRIES) -> DataFrame:
    """(lang, term, sources, counts) for every term that at least `least` documents of a language have."""
    shards = shuffle_partitions(docs.sparkSession)
    runs = grouped(docs).mapInArrow(_index(shards, entries), _RUN)
    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("first")
    return dealt.mapInArrow(_merge(least), _TERMS)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (n + 2 * v)), exactly; null where v is 0."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = F.nullif(n + 2 * v, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", top, whole)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _own_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms of a source change against sources that lack them, by pair: for each value p that `n` terms of the source have."""
    sums: dict[tuple, np.ndarray] = {}
    others: dict[tuple, tuple[list, np.ndarray]] = {}
    for b in batches:
        c = {name: b.column(name) for name in b.schema.names}
        p, n, p0 = (c[k].to_pylist() for k in ("p", "n", "p0"))
        for i, key in enumerate(zip(c["lang"].to_pylist(), c["source"].to_pylist(), c["block"].to_pylist(), strict=True)):
            block = (key[0], key[2])
            if block not in others:
                rows = c["others"][i].as_py()
                others[block] = [r["other"] for r in rows], np.array([r["q0"] for r in rows], np.int64)
            q0 = others[block][1]
            change = n[i] * (_apart(np.int64(p[i]), q0) - _apart(np.int64(p0[i]), q0))
            sums[key] = sums[key] + change if key in sums else change
    for (lang, source, block), total in sums.items():
        rows = [(lang, source, o, t) for o, t in zip(others[lang, block][0], total.tolist(), strict=True) if o != source]
        if rows:
            yield _rows(rows, _PAIRS_ARROW)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, postings of one term) into the corrections of pairs of sources that have terms in common."""
    sums: dict[tuple[str, str, str], int] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = [(*k, v) for k, v in sums.items()]
        for i in range(0, len(rows), 65536):
            yield _rows(rows[i : i + 65536], _PAIRS_ARROW)
        sums.clear()

    for b in batches:
        postings = b.column("postings")
        flat, ends = postings.flatten(), np.cumsum(postings.value_lengths().to_numpy(zero_copy_only=False))
        if not len(flat):
            continue
        langs = b.column("lang").dictionary_encode()
        sources = flat.field("source").dictionary_encode()
        lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends, prepend=0))
        own = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("p", "p0"))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        left = np.arange(len(flat))
        step = 1
        while True:  # each posting with the one `step` places on, for all terms at once
            left = left[left + step < end[left]]
            if not len(left):
                break
            right = left + step
            change = _apart(p[left], p[right]) - _apart(p[left], p0[right]) - _apart(p0[left], p[right]) + _apart(p0[left], p0[right])
            code = (lang[left] * len(source_names) + own[left]) * len(source_names) + own[right]
            distinct, back = np.unique(code, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, back, change)
            for d, t in zip(distinct.tolist(), total.tolist(), strict=True):
                d, o = divmod(d, len(source_names))
                d, s = divmod(d, len(source_names))
                key = (lang_names[d], source_names[s], source_names[o])
                sums[key] = sums.get(key, 0) + t
            if len(sums) >= 1 << 19:
                yield from flushed()
            step += 1
    yield from flushed()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """Each (lang, source) of `docs` (lang, source, text) against the other sources of its language and against the whole language:
    lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII, ASCII in lower case. A language keeps those that at least `least` of its
    documents have. `pair` rows hold the sum of differences to another source over all kept terms, 0 where a language keeps none;
    `term` rows the `top` terms that a source uses more than its language does. Null language, source and text count as ''; texts
    without terms still make a group; repeated rows count again; equal values are ranked by item. No rows give no rows. Other
    columns are not looked at. All sums are of integers. A task holds a block of `entries` postings and the distinct terms of one text.
    """
    kept = stored(frequencies(docs, least, entries), "divergence-terms")
    every = grouped(docs).select("lang", "source").distinct()
    postings = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("all"),
                           F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "all", F.col("x.sources").alias("source"), F.col("x.counts").alias("count")
    )
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    words = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("bigint")
    groups = (
        every.join(words, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"))
        .withColumn("p0", share(zero, F.col("n"), F.col("v")))
    )
    groups = stored(groups, "divergence-groups")
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    valued = stored(
        postings.join(groups, ["lang", "source"])
        .join(whole, "lang")
        .select(
            "lang", "source", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
            share(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"), "p0",
        ),
        "divergence-values",
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words_out = (
        valued.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    pairs = _pairs(groups, valued).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(words_out)


def _pairs(groups: DataFrame, valued: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # the output has a row for each pair of these
    blocks = (
        groups.withColumn("block", F.floor(turn / BLOCK))
        .groupBy("lang", "block")
        .agg(F.collect_list(F.struct(F.col("source").alias("other"), F.col("p0").alias("q0"))).alias("others"))
    )
    base = (
        groups.join(blocks, "lang")
        .select("lang", "source", "v", "p0", F.explode("others").alias("x"))
        .where("x.other <> source")
        .select("lang", "source", F.col("x.other").alias("other"),
                F.coalesce(F.col("v") * apart(F.col("p0"), F.col("x.q0")), F.lit(0).cast("bigint")).alias("value"))
    )
    own = valued.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n")).join(blocks, "lang")
    one_sided = own.mapInArrow(_own_values, _PAIRS)
    posting = F.struct("source", "p", "p0")
    common = valued.groupBy("lang", "term").agg(F.array_sort(F.collect_list(posting)).alias("postings")).where("size(postings) > 1")
    changes = one_sided.unionByName(common.select("lang", "postings").mapInArrow(_corrections, _PAIRS))
    changes = changes.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    turned = changes.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    return (
        base.unionByName(changes)
        .unionByName(turned)
        .groupBy("lang", "source", "other")
        .agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    )
