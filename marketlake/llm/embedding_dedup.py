"""Near duplicates of embeddings by cosine, with hierarchical navigable small-world graphs.

Vectors of a label are dealt to shards of bounded size, and each shard gets a graph of its own, in a file of the shared folder. Of every two
shards of a label one row names the files; a task reads them, each shard asks the other's graph, and a link found from either side
counts for both. A search keeps a beam of the nearest vectors seen; it ends when none of them is left to expand. A query whose
beam holds links only is asked again with four times the beam, for then more may lie behind.

An audit compares some queries with the whole shard: up to `AUDIT` of those that are known to link, from either side, and one in `BLIND` of all.
Links of a vector to itself are not counted. If the graph has missed a link, all queries not audited are asked again with four times
the beam and a new audit is drawn from them, until one passes; a beam of more than one part in `WHOLE` of the shard gives way to the whole
shard. What an audit finds counts as found. What a search returns is verified in double precision. The rows of an audit say how many
queries there were and how many were compared with the whole shard.

Links leave a task as counts for each vector and as a forest that joins the same vectors, never as pairs; forests are united by
components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm._tables import components, file_system, new_file, shuffle_partitions, stored
from marketlake.plans.scratch import scratch_path

THRESHOLD = 0.98
#: Vectors of a shard, about, and of a block whose links are made a forest at once.
SHARD, BLOCK = 4096, 1024
#: Links of a vector in the upper levels and in the lowest, beams of building and searching.
LINKS, BASE_LINKS, BUILD, BEAM = 12, 24, 48, 32
#: Queries that link, to no more vectors than a beam holds, of an audit; one in so many of all queries is audited besides.
AUDIT, BLIND = 128, 32
#: A widened beam of more than this part of the shard gives way to the whole shard.
WHOLE = 8
#: Pairs of shards for a task, about, where they are many.
PAIRS = 16


def _distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - cosine of each query with its candidates; x and q have length one."""
    return 1.0 - np.einsum("qkd,qd->qk", x[at], q)


def search_level(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams (ids, distances; nearest first) of queries `q`, all searched at once on one level.

    links: neighbours of each vector, -1 for none. entry: places to begin at, for each query.
    """
    n_q, n = len(q), len(x)
    beam = max(beam, entry.shape[1])
    ids = np.full((n_q, beam), -1)
    far = np.full((n_q, beam), np.inf)
    k = entry.shape[1]
    ids[:, :k], far[:, :k] = entry, np.where(entry >= 0, _distances(x, np.maximum(entry, 0), q), np.inf)
    seen = np.zeros((n_q, n + 1), bool)
    seen[np.arange(n_q)[:, None], entry] = True
    seen[:, n] = True
    opened = ids < 0
    live = np.arange(n_q)
    while len(live):
        # The nearest unopened vector of each beam; a search ends when there is none.
        waiting = np.where(opened[live], np.inf, far[live])
        best = waiting.argmin(axis=1)
        go = waiting[np.arange(len(live)), best] < np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        near = links[ids[live, best]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        some = fresh.any(axis=1)
        if not some.any():
            continue
        rows, near, fresh = live[some], near[some], fresh[some]
        d = np.where(fresh, _distances(x, np.where(fresh, near, 0), q[rows]), np.inf)
        all_ids = np.concatenate((ids[rows], np.where(fresh, near, -1)), axis=1)
        all_far = np.concatenate((far[rows], d), axis=1)
        all_open = np.concatenate((opened[rows], ~fresh), axis=1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        r = np.arange(len(rows))[:, None]
        ids[rows], far[rows], opened[rows] = all_ids[r, keep], all_far[r, keep], all_open[r, keep]
    order = np.argsort(far, axis=1, kind="stable")
    r = np.arange(n_q)[:, None]
    return ids[r, order], far[r, order]


def _choose(x: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> list[int]:
    """Up to `most` of the candidates, nearest first, each nearer to the new vector than to those chosen; then the nearest of the rest."""
    real = np.flatnonzero(np.isfinite(far) & (ids >= 0))
    ids, far = ids[real], far[real]
    if len(ids) <= most:
        return ids.tolist()
    between = 1.0 - x[ids] @ x[ids].T
    chosen: list[int] = []
    closest = np.full(len(ids), np.inf)
    for i in range(len(ids)):
        if far[i] <= closest[i]:
            chosen.append(i)
            closest = np.minimum(closest, between[i])
            if len(chosen) == most:
                break
    taken = set(chosen)
    chosen += [i for i in range(len(ids)) if i not in taken][: most - len(chosen)]
    return ids[chosen].tolist()


class Graph:
    """A graph of levels over unit vectors `x`; a vector's highest level is geometric."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x = x
        n = len(x)
        rng = np.random.default_rng(seed)
        top = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
        order = np.argsort(-top, kind="stable")  # the highest come first, so an entry is always there
        self.entry = int(order[0])
        self.links = [np.full((n, BASE_LINKS if k == 0 else LINKS), -1) for k in range(int(top[self.entry]) + 1)]
        done = 1
        while done < n:
            batch = order[done : done + min(max(8, done // 2), 256)]
            self._insert(batch, top)
            done += len(batch)

    def _insert(self, batch: np.ndarray, top: np.ndarray) -> None:
        """Finds the neighbours of a batch on the graph so far, then links both ways; the batch's own nearest count too."""
        at = np.full((len(batch), 1), self.entry)
        within = 1.0 - self.x[batch] @ self.x[batch].T
        np.fill_diagonal(within, np.inf)
        for k in range(len(self.links) - 1, -1, -1):
            here = top[batch] >= k
            ids, far = search_level(self.x, self.links[k], self.x[batch], at, BUILD if here.any() else 1)
            at = ids[:, :1]
            most = self.links[k].shape[1]
            for b in np.flatnonzero(here):
                peers = np.flatnonzero(here)
                peers = peers[peers != b]
                if len(peers) > most:
                    peers = peers[np.argpartition(within[b, peers], most)[:most]]
                every, dist = np.concatenate((ids[b], batch[peers])), np.concatenate((far[b], within[b, peers]))
                order = np.argsort(dist, kind="stable")
                chosen = _choose(self.x, every[order], dist[order], most // 2 if k == 0 else most)
                self._link(k, int(batch[b]), chosen)

    def _link(self, k: int, new: int, chosen: list[int]) -> None:
        table = self.links[k]
        for a, b in [(new, c) for c in chosen] + [(c, new) for c in chosen]:
            row = table[a]
            if b in row:
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = b
                continue
            every = np.append(row, b)
            dist = 1.0 - self.x[every] @ self.x[a]
            order = np.argsort(dist, kind="stable")
            table[a] = _choose(self.x, every[order], dist[order], len(row))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            at = search_level(self.x, self.links[k], q, at, 1)[0][:, :1]
        return search_level(self.x, self.links[0], q, at, beam)


def _blob(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _build(folder: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        x = _unit(table.column("embedding").combine_chunks())
        graph = Graph(x)
        levels = {f"level{k}": t.astype(np.int32) for k, t in enumerate(graph.links)}
        data = _blob(x=x, ids=np.asarray(table.column("vec_id")), entry=np.array(graph.entry), **levels)
        uri, fs, path = new_file(folder, ".graph")
        with fs.open_output_stream(path, compression=None) as f:
            f.write(data)
        one = table.slice(0, 1).select(["label", "width", "shard"])
        return one.append_column("path", pa.array([uri], pa.string()))

    return run


def _read(uri: str) -> tuple[Graph, np.ndarray]:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return _load(f.read())


def _load(data: bytes) -> tuple[Graph, np.ndarray]:
    z = np.load(io.BytesIO(data))
    graph = Graph.__new__(Graph)
    graph.x, graph.entry = z["x"], int(z["entry"])
    graph.links = [z[f"level{k}"] for k in range(sum(n.startswith("level") for n in z.files))]
    return graph, z["ids"]


def _exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (query, vector) link in double precision, the same from either side."""
    return np.concatenate([np.einsum("nd,nd->n", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, max(1, len(a)), 65536)]) >= threshold


def _scan(graph: Graph, q: np.ndarray, some: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All links of some queries, by a look at each vector of the shard."""
    r, c = np.nonzero(q[some] @ graph.x.T >= threshold - 1e-6)
    r = some[r]
    real = _exact(q, graph.x, r, c, threshold)
    return r[real], c[real]


def _searched(graph: Graph, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Links that the graph finds, as a table of queries and vectors."""
    limit, n = 1.0 - threshold, len(graph.x)
    found = np.zeros((len(q), n), bool)
    todo, width = np.arange(len(q)), beam
    step = max(1, (1 << 22) // (n + 1))
    while len(todo):
        # A beam widened as far as this costs more than a look at each vector, which is a beam as wide as the shard.
        whole, full = width > beam and width > n // WHOLE, []
        for some in np.split(todo, range(step, len(todo), step)):
            if whole:
                a, b = _scan(graph, q, some, threshold)
            else:
                ids, far = graph.search(q[some], width)
                hit = (far <= limit + 1e-6) & (ids >= 0)
                over = hit.all(axis=1)  # links only: there may be more behind
                full.append(some[over])
                r, c = np.nonzero(hit & ~over[:, None])
                a, b = some[r], ids[r, c]
                real = _exact(q, graph.x, a, b, threshold)
                a, b = a[real], b[real]
            found[a, b] = True
        todo, width = np.concatenate(full) if full else np.empty(0, int), width * 4
    return found


def audited(
    graph: Graph, q: np.ndarray, threshold: float, own: np.ndarray, beam: int = BEAM, known: np.ndarray | None = None,
    found: np.ndarray | None = None,
) -> tuple[np.ndarray, int, int, int]:
    """The table of links found by the graph and by audits; how many the audits saw, how many of them the graph had found, and how many
    queries were compared with the whole shard.

    own: the place of each query in the shard, -1 for none; a link of a vector to itself is not counted. known: the queries that
    link as seen from elsewhere. found: what a first search has found.
    """
    found = _searched(graph, q, threshold, beam) if found is None else found
    known = np.zeros(len(q), bool) if known is None else known
    inside = own >= 0
    rng = np.random.default_rng(0)
    left, width = np.arange(len(q)), beam
    links = hits = 0
    while len(left):
        other = found.copy()
        other[inside, own[inside]] = False
        each = other.sum(axis=1)
        seen = known | (each > 0)
        seen[inside] |= other.any(axis=0)[own[inside]]
        # Queries of more links are asked with wider beams, up to the whole shard, and say nothing about the others.
        linking = left[seen[left] & (each[left] <= beam)]
        some = np.union1d(rng.permutation(linking)[:AUDIT], rng.permutation(left)[: -(-len(left) // BLIND)])
        a, b = _scan(graph, q, some, threshold)
        real = b != own[a]
        n, hit = int(real.sum()), int(found[a[real], b[real]].sum())
        links, hits = links + n, hits + hit
        found[a, b] = True
        left = np.setdiff1d(left, some)
        if hit == n:
            break
        width *= 4
        if width > len(graph.x) // WHOLE:
            a, b = _scan(graph, q, left, threshold)
            found[a, b] = True
            left = left[:0]
        elif len(left):
            found[left] |= _searched(graph, q[left], threshold, width)
    return found, links, hits, len(q) - len(left)


def linked(graph: Graph, q: np.ndarray, threshold: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(query, vector) of the links found, and the part of the audited ones that the graph had found itself."""
    found, links, hits, _ = audited(graph, q, threshold, np.full(len(q), -1) if own is None else own, beam)
    a, b = np.nonzero(found)
    return a, b, hits / links if links else 1.0


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same ids as (a, b) and hold no circle; each goes to the smallest id of its tree."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(ids)))
    return list(zip(ids[low[moved]].tolist(), ids[moved].tolist(), strict=True))


LINKS_FOUND = "vec_id long, n long, a long, b long, audited long, hits long, queries long, scanned long"


def _between(low: str, high: str, threshold: float, block: int) -> list[tuple]:
    """The links of a shard, or those between two, as rows of `LINKS_FOUND`."""
    rows: list[tuple] = []
    x, x_ids = _read(low)
    if low == high:
        y, y_ids = x, x_ids
        found, links, hits, scanned = audited(x, x.x, threshold, np.arange(len(x_ids)))
        rows.append((None, None, None, None, links, hits, len(x_ids), scanned))
        found |= found.T.copy()
        np.fill_diagonal(found, False)
        counts = [(x_ids, found.sum(axis=1))]
    else:
        y, y_ids = _read(high)
        ways = [(y, x.x), (x, y.x)]
        first = [_searched(graph, q, threshold, BEAM) for graph, q in ways]
        heard = [first[1].any(axis=0), first[0].any(axis=0)]
        both = []
        for (graph, q), known, seen in zip(ways, heard, first, strict=True):
            some, links, hits, scanned = audited(graph, q, threshold, np.full(len(q), -1), known=known, found=seen)
            rows.append((None, None, None, None, links, hits, len(q), scanned))
            both.append(some)
        found = both[0] | both[1].T
        counts = [(x_ids, found.sum(axis=1)), (y_ids, found.sum(axis=0))]
    for ids, n in counts:
        rows += [(int(v), int(k), *[None] * 6) for v, k in zip(ids, n, strict=True) if k]
    edges = []
    for i in range(0, len(x_ids), block):
        a, b = np.nonzero(found[i : i + block])
        edges += _forest(x_ids[a + i], y_ids[b])
    if edges:
        rows += [(None, None, a, b, *[None] * 4) for a, b in _forest(*np.array(edges).T)]
    return rows


def _ask(threshold: float, block: int):
    names = [c.split()[0] for c in LINKS_FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in batches:
            for low, high in zip(pairs.column("low").to_pylist(), pairs.column("high").to_pylist(), strict=True):
                rows = _between(low, high, threshold, block)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that can link: with id, label and embedding, all components finite numbers, not all of them zero."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    ).where("vec_id is not null and label is not null and embedding is not null").where(finite & some)


def search_links(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Links as rows of three kinds: (vec_id, n) counts, (a, b) edges of forests, and of each audit how many links it saw, how many of them
    the graph had found, how many queries there were and how many of them were compared with the whole shard.

    Vectors of different lengths do not link. Repeated ids are one vector: the row with the first embedding by order counts.
    """
    rows = (
        usable(vectors).groupBy("vec_id", "label").agg(F.min("embedding").alias("embedding"))
        .withColumn("width", F.size("embedding"))
    )
    rows = stored(rows, "embeddings")
    sizes = rows.groupBy("label", "width").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard")
    kind = vectors.schema["label"].dataType.simpleString()
    spark = vectors.sparkSession
    graphs = stored(
        rows.join(sizes, ["label", "width"]).select("vec_id", "embedding", "label", "width", dealt)
        .groupBy("label", "width", "shard")
        .applyInArrow(_build(scratch_path(spark, "embedding-graphs")), f"label {kind}, width int, shard int, path string"),
        "embedding-shards",
    )
    later = F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))
    lows = graphs.join(sizes, ["label", "width"]).select("label", "width", F.col("path").alias("low"), later.alias("shard"))
    pairs = lows.join(graphs.withColumnRenamed("path", "high"), ["label", "width", "shard"]).select("low", "high")
    n = sizes.agg(F.sum(F.col("shards") * (F.col("shards").cast("long") + 1) / 2)).first()[0] or 0
    tasks = max(shuffle_partitions(spark), int(n) // PAIRS)
    return stored(pairs.repartition(tasks, "low", "high").mapInArrow(_ask(threshold, block), LINKS_FOUND), "embedding-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Every row of `vectors` (vec_id, embedding, label, ...) as vec_id, n_links, component_id, kept.

    Only vectors of one label link, at a cosine of `threshold` or more in double precision. Rows without label or with an
    embedding that is null, empty, zero or holds null or non-finite numbers have no links and are their own component, as
    have rows without id, whose component is null. Other columns are not looked at.
    """
    links = search_links(vectors, threshold, shard, block)
    counts = links.where("vec_id is not null").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    found = components(links.where("a is not null").select("a", "b"), "embedding-components")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = rows.join(counts, "vec_id", "left").join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
