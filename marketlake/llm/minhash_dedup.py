"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash, bands, and exact checks.

A text is the multiset of its runs of `SHINGLE` words; the weight of a run is how often it occurs. Weights are discretised
at 1, 2, 4, ...: the copies above 2**(k-1) up to 2**k of a run form its level k (the first copy is level 0), and each level has
a Poisson process of its own with a rate in proportion to its copies. A point falls on one signature component and one copy of its
level; it counts if the text holds that copy. A component takes its earliest point, so two texts agree in a component with a probability
equal to their weighted Jaccard similarity. Points are made in order of time, all texts of a group at once, up to a
horizon after which every component is most likely filled; where one is not, the horizon doubles.

Texts with equal multisets are one node. Nodes that agree in a whole band are candidates; a bucket of the band is never
expanded into pairs: its members are first compared with its smallest node, and members that are then still in
different components are compared with each other only where their rarest runs meet, as those of similar
texts must. Candidates are verified on the whole multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm._tables import all_of, components, shuffle_partitions, stored
from marketlake.llm._words import mix, places, runs, split, text_groups

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 6
#: Pairs of one node that share a copy of its text when they are verified.
PER_COPY = 64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, and the index of each text's first.

    A text of fewer words is one run of them all; a text without words has none.
    """
    starts, _, h = split(data)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    out = runs(h, size)[places(first, size)]
    sizes = np.maximum(counts - size + 1, 0)
    for n in range(1, size):  # the short ones
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = runs(h, n)[first[short]] + np.uint64(n)
            at = np.cumsum(sizes)[short]
            out = np.insert(out, at, whole)
            sizes[short] = 1
    return out, np.concatenate(([0], np.cumsum(sizes)))


def multisets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each different run."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])))) if len(t) else np.empty(0, int)
    return t[new], h[new], np.diff(np.append(new, len(t)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures of texts with at least one run: (texts, size) of 64-bit marks of the earliest points."""
    levels = 1 + np.frexp(weights - 1.0)[1]
    unit = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(levels) - levels, levels)
    copies = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    # Of the last level only the copies up to the weight are inside.
    lowest = np.where(level == 0, 0, copies)
    inside = np.minimum(copies, weights[unit] - lowest)
    real = inside > 0
    unit, level, copies, inside = unit[real], level[real], copies[real], inside[real]
    of = text[unit]
    seed = mix(hashes[unit] ^ (level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    total = np.bincount(text, weights, n_texts)
    horizon = (np.log(size) + 5.0) / np.maximum(total, 1)
    best = np.full((n_texts, size), np.inf)
    marks = np.zeros((n_texts, size), np.uint64)
    todo = np.arange(n_texts)[total > 0]
    live = np.isin(of, todo)
    while len(todo):
        time = np.zeros(int(live.sum()))
        state, at, rate, share, doc = seed[live], of[live], copies[live] * size, inside[live] / copies[live], of[live]
        while len(state):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(_uniform(state)) / rate
            stay = time <= horizon[at]
            state, time, at, rate, share, doc = state[stay], time[stay], at[stay], rate[stay], share[stay], doc[stay]
            if not len(state):
                break
            place = mix(state ^ np.uint64(0x5851F42D4C957F2D))
            held = _uniform(mix(place)) < share  # the point's copy is one that the text holds
            slot = doc[held] * size + (place[held] % np.uint64(size)).astype(np.int64)
            t, m = time[held], place[held]
            order = np.lexsort((t, slot))
            slot, t, m = slot[order], t[order], m[order]
            head = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.empty(0, bool)
            slot, t, m = slot[head], t[head], m[head]
            flat, flat_marks = best.reshape(-1), marks.reshape(-1)
            better = t < flat[slot]
            flat[slot[better]], flat_marks[slot[better]] = t[better], m[better]
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        horizon[todo] *= 2
        live = np.isin(of, todo)
    return marks


def _sign(bands: int, rows: int, size: int):
    width = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_groups(b.column(1)):
                h, first = shingles(data, offsets, size)
                t, h, w = multisets(h, first)
                marks = signatures(t, h, w, j - i, width)
                salted = mix(h * np.uint64(2) + np.uint64(1)) * w.astype(np.uint64)
                edges = np.searchsorted(t, np.arange(j - i + 1))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (h * w.astype(np.uint64), salted)]
                one, two = (mix(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums)
                n = np.bincount(t, w, j - i).astype(np.int64)
                keys = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ marks[:, r::rows][:, :bands])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                flat = pa.array(keys.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat)
                yield pa.record_batch(
                    [b.column(0)[i:j], pa.array(one), pa.array(two), pa.array(n), lists],
                    names=["doc_id", "bag", "bag2", "n_shingles", "bands"],
                )

    return run


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, a digest of the multiset (bag, bag2, n_shingles), and one key for each band."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _sign(bands, rows, size), "doc_id long, bag long, bag2 long, n_shingles long, bands array<long>"
    )


def _compare(size: int):
    """Rows of a hub, its own text first, then those of others: the similarity of each to the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, bags = None, []
        for b in batches:
            out = []
            for i, j, data, offsets in text_groups(b.column("text")):
                h, first = shingles(data, offsets, size)
                a, c, other = (b.column(n)[i:j].to_pylist() for n in ("a", "copy", "b"))
                for k in range(j - i):
                    own = np.unique(h[first[k] : first[k + 1]], return_counts=True)
                    if (a[k], c[k]) != hub:
                        hub, bags = (a[k], c[k]), []
                    if other[k] is None:
                        bags.append(own)
                    else:
                        out.append((a[k], other[k], max(map(lambda x: _jaccard(x, own), bags), default=0.0)))
            x, y, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"]
            )

    return run


def _jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted hashes, weights)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(x[1][i], y[1][j]).sum())
    whole = int(x[1].sum() + y[1].sum()) - shared
    return shared / whole if whole else 0.0


def compared(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The similarity of each of `pairs` (a, b), from the whole `texts` (id, text).

    The text of `a` goes along once for every `PER_COPY` pairs or so, and a hub's pairs spread over as many tasks.
    The pairs are stored, as they are read several times.
    """
    pairs = stored(pairs, "near-pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_COPY).alias("copies"))
    dealt = pairs.join(hubs, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies"))
    rows = dealt.select("a", "copy", "b", F.col("b").alias("id")).unionByName(
        dealt.select("a", "copy").distinct().select("a", "copy", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("id"))
    )
    return (
        rows.join(texts, "id")
        .select("a", "copy", "b", "text")
        .repartition(shuffle_partitions(pairs.sparkSession), "a", "copy")
        .sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first())
        .mapInArrow(_compare(size), "a long, b long, similarity double")
        .groupBy("a", "b")
        .agg(F.max("similarity").alias("similarity"))
    )


def _linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with `component`, the smallest node reachable by `links`."""
    found = components(links.select("a", "b"), "near-components")
    return nodes.join(found, nodes["node"] == found["id"], "left").select(
        *[nodes[c] for c in nodes.columns], F.coalesce("component", "node").alias("component")
    )


def _open(buckets: DataFrame, grouped: DataFrame) -> DataFrame:
    """node, component: the nodes of buckets whose nodes are in different components."""
    rows = buckets.select("key", "node").join(grouped, "node")
    several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return rows.join(several.select("key"), "key").select("node", "component").distinct()


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_groups(b.column("text")):
                t, h, w = multisets(*shingles(data, offsets, size))
                which = np.repeat(np.arange(len(t)), w)
                copy = (np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)).astype(np.uint64)
                element = mix(h[which] + copy * np.uint64(0xA24BAED4963EE407)).view(np.int64)
                row = pa.array(t[which])
                total = pa.array(np.bincount(t, w, j - i).astype(np.int32)[t[which]])
                columns = [b.column(c).slice(i, j - i).take(row) for c in ("node", "component", "mark")]
                for at in range(0, len(which), 1 << 16):
                    cut = [c.slice(at, 1 << 16) for c in (*columns, pa.array(element), total)]
                    yield pa.record_batch(cut, names=["node", "component", "mark", "element", "size"])

    return run


def _parts(texts: DataFrame, size: int) -> DataFrame:
    """Each copy of each run as an element of its text (node, component, mark), and the text's number of elements.

    The Jaccard similarity of these sets is that of the multisets. A node has a set for each of its texts.
    """
    return texts.mapInArrow(_elements(size), "node long, component long, mark long, element long, size int")


def overlapping(parts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that can reach `threshold`: all that do, and few others.

    Elements are put in one order, the rarest first. The first element that two sets share, at places i and j, leaves at most
    min(size - i, other size - j) others to share. So sets with a similarity of `threshold` meet in
    the first places of both, which common elements seldom reach in sets with rare elements of their own.
    """
    common = parts.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    places = parts.join(common, "element", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = Window.partitionBy("node", "mark").orderBy("n", "element")
    head = places.withColumn("place", F.row_number().over(order)).where(
        (F.col("n") > 1) & (F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    )
    head = stored(head.select("element", "node", "component", "size", "place"), "near-heads")
    x, y = head.alias("x"), head.alias("y")
    need = (F.col("x.size") + F.col("y.size")) * (threshold / (1 + threshold)) - 1e-6
    shared = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    return (
        x.join(
            y,
            (F.col("x.element") == F.col("y.element"))
            & (F.col("x.node") < F.col("y.node"))
            & (F.col("x.component") != F.col("y.component"))
            & (shared >= need),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Every row of `docs` (doc_id, text, ...) as doc_id, class_id, kept.

    class_id is the smallest doc_id of the texts linked, directly or through others, by a similarity of `threshold` or more; kept tells
    whether it is the row's own. Null, empty and blank texts have no shingles and link with nothing. Rows
    that repeat a doc_id are one document: each of its texts links it. A row without doc_id is a class of its own,
    with null as its class_id. Other columns are not looked at.
    """
    sign = stored(signed(docs, bands, rows, size), "near-signatures")
    known = sign.where("doc_id is not null and n_shingles > 0")
    bags = stored(known.groupBy("bag", "bag2", "n_shingles").agg(F.min("doc_id").alias("node")), "near-bags")
    member = stored(
        known.select("doc_id", "bag", "bag2", "n_shingles").distinct().join(bags, ["bag", "bag2", "n_shingles"]).select("doc_id", "node"),
        "near-members",
    )
    first = bags.select(F.col("node").alias("doc_id"), "bag", "bag2", "n_shingles")
    keys = (
        known.join(first, ["doc_id", "bag", "bag2", "n_shingles"])
        .select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
        .distinct()
    )
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = stored(keys.join(hubs, "key"), "near-buckets")
    stars = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    wanted = buckets.select(F.col("node").alias("id")).distinct()
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null")
    texts = stored(source.join(wanted, "id", "left_semi"), "near-texts")
    measured = stored(compared(stars, texts, size), "near-stars")
    same_id = member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = measured.where(F.col("similarity") >= threshold).select("a", "b").unionByName(same_id)
    nodes = buckets.select("node").distinct()
    grouped = stored(_linked(nodes, links), "near-groups")
    # What one comparison with the hub leaves open: members of different components of a bucket.
    left = stored(_open(buckets, grouped), "near-open")
    whole = left.join(texts, left["node"] == texts["id"]).select("node", "component", "text", F.xxhash64("text").alias("mark"))
    parts = stored(_parts(whole.dropDuplicates(["node", "mark"]), size), "near-parts")
    rest = overlapping(parts, threshold)
    late = stored(compared(rest, texts, size).where(F.col("similarity") >= threshold).select("a", "b"), "near-late")
    every = components(links.unionByName(late), "near-classes")
    classes = member.join(every, member["doc_id"] == every["id"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("class_id")
    )
    out = sign.select("doc_id").join(classes, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` of which each class keeps one: that with the smallest doc_id (all rows that repeat it stay)."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti").select(*all_of(docs))
