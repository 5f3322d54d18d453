"""The trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its smallest member and its depth: the members of a node are the
conversations that begin with it, so every conversation is the smallest member of one stretch of its own path, or of none.

Sums over subtrees come from splitting the forest of parent edges. A node weighs as many conversations as it has, so the weight of
a subtree is what its members have left to say: known from the members alone, without a sum over nodes. In a component the nodes
whose subtree holds half of the weight or more are a path from the top to the centroid. In each round every component adds
up its nodes below the centroid, adds that total to the nodes of that path, gives up the centroid, and falls apart into one component for each child of
the centroid and one for what is above. No component keeps more than half of the weight, so a chain of turns takes as few rounds as a
bush. Components of up to `NODES` nodes are split on in one task each, many at a time; larger ones, in rounds of joins. What
lies below a centroid, and under which child, is looked up on the path of a node's smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm._ranges import running
from marketlake.llm._tables import shuffle_partitions, stored

#: Turns of the other conversation that a rebuilt one may begin with, at most; conversations share in hundreds.
HEAD, SHARE = 6, 100
#: Nodes of a component that is split in one task.
NODES = 1 << 16
#: Bytes of ids in one row on their way to a digest.
PACK = 1 << 16

_SUMS = ["s0", "s1", "s2", "s3"]
_ROOT = b"\0" * 16
_ADDED = ["conv_id", "depth", "n_leaves", "saved_tokens"]
_ADDED_SCHEMA = "conv_id long, depth long, n_leaves long, saved_tokens long"
#: In a component: its top's name, the node's name, weight and weight below in the component, values and sums so far.
_STATE = ["top_conv", "top_depth", "conv_id", "depth", "parent_conv_id", "weight", "below", "leaf", "saved", "n_leaves", "saved_tokens"]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `turns` (conv_id, turn, role, text): convs (conv_id, len), and rows (conv_id, len, depth, content, chars) of every
    rebuilt conversation. content is a SHA-256 of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", content.alias("content"),
        F.length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("row"), F.lit(1).cast("bigint").alias("one"),
    )
    own = stored(own, "trie-turns")
    placed = stored(
        running(own, ["conv_id"], ["turn", "content", "row"], {"before": "one"}, "trie-ranked").select(
            "conv_id", (F.col("before") + 1).alias("place"), "content", "chars"
        ),
        "trie-placed",
    )
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"share": share, "base": F.col("conv_id") - F.col("conv_id") % SHARE}
    )
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    head = F.least("share", F.coalesce("base_n", F.lit(0).cast("bigint")))
    convs = convs.join(bases, "base", "left").withColumn("head", head)
    convs = stored(convs.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("share"), F.lit(0))), "trie-convs")
    heads = placed.where((F.col("place") < HEAD) & (F.col("conv_id") % SHARE == 0)).withColumnRenamed("conv_id", "base")
    first = convs.where("head > 0").join(heads, "base").where("place <= head")
    rest = placed.join(convs.select("conv_id", "share", "head", "len"), "conv_id").where("place > share")
    rows = first.select("conv_id", "len", F.col("place").alias("depth"), "content", "chars").unionByName(
        rest.select("conv_id", "len", (F.col("place") - F.col("share") + F.col("head")).alias("depth"), "content", "chars")
    )
    return convs.select("conv_id", "len"), rows


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth, *sums), 256), 1, 32))


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds to each row of a rebuilt conversation the key of its prefix and of the prefix before it, 16 bytes each.

    A prefix is told by the sums, over its turns, of four 32-bit pieces of a SHA-256 of depth and content. Sums can be taken range by range.
    """
    digest = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), F.col("content")), 256)
    piece = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint")
    own = rows.withColumn("digest", digest).select(
        "conv_id", "len", "depth", "chars", *[piece(i).alias(f"own{i}") for i in range(4)]
    )
    summed = running(stored(own, "trie-own"), ["conv_id"], ["depth"], {s: f"own{i}" for i, s in enumerate(_SUMS)}, "trie-sums")
    before = _key(F.col("depth") - 1, [F.col(s) for s in _SUMS])
    return summed.select(
        "conv_id", "len", "depth", "chars",
        _key(F.col("depth"), [F.col(s) + F.col(f"own{i}") for i, s in enumerate(_SUMS)]).alias("key"),
        F.when(F.col("depth") == 1, F.lit(_ROOT)).otherwise(before).alias("parent_key"),
    )


def _nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """Every node with its own figures: key, depth, conv_id, parent_conv_id, n_convs, n_children, weight, below, leaf, saved."""
    found = paths.groupBy("key", "parent_key", "depth", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("depth") + 1).alias("below")
    )
    # The root is on the path of all; it gets its row apart, so that no table has a row of it for each conversation.
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") + 1).alias("below")).where("n_convs > 0")
    root = root.select(
        F.lit(_ROOT).alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("chars"), "conv_id", "n_convs", "below",
    )
    found = stored(found.unionByName(root), "trie-found")
    children = found.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    parents = found.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    n_children = F.coalesce("n_children", F.lit(0).cast("bigint"))
    return found.join(children, "key", "left").join(parents, "parent_key", "left").select(
        "key", "depth", "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"), F.col("n_convs").alias("weight"), "below",
        (n_children == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )


def _owners(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, at, owner, above): for the path of every smallest member, the node at each depth and the one before it."""
    members = nodes.select(F.col("conv_id").alias("path")).distinct()
    named = nodes.where("depth > 0").select("key", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("above"))
    return (
        paths.select(F.col("conv_id").alias("path"), F.col("depth").alias("at"), "key")
        .join(members, "path", "left_semi")
        .join(named, "key")
        .select("path", "at", "owner", "above")
    )


def rolled_up(paths: DataFrame, nodes: DataFrame, most: int = NODES) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): the sums over the subtree of every node."""
    zero = F.lit(0).cast("bigint")
    top = nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv"), F.lit(0).cast("bigint").alias("top_depth"))
    live = nodes.join(F.broadcast(top)).withColumns({"n_leaves": zero, "saved_tokens": zero}).select(*_STATE)  # one row
    live, owners, small, done = stored(live, "trie-live"), None, [], []
    while True:
        sizes = live.groupBy("top_conv", "top_depth").agg(F.count("*").alias("n"), F.max("below").alias("total"))
        sizes = stored(sizes, "trie-sizes")
        marked = live.join(sizes, ["top_conv", "top_depth"])
        small.append(marked.where(F.col("n") <= most).select(*_STATE))
        if sizes.where(F.col("n") > most).isEmpty():
            break
        if owners is None:
            owners = stored(_owners(paths, nodes), "trie-owners")
        live, given_up = _split(marked.where(F.col("n") > most), owners)
        done.append(given_up)
    dealt = small[0]
    for s in small[1:]:
        dealt = dealt.unionByName(s)
    spark = paths.sparkSession
    dealt = dealt.repartition(shuffle_partitions(spark), "top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth")
    out = dealt.mapInArrow(_small(most), _ADDED_SCHEMA)
    for d in done:
        out = out.unionByName(d)
    return out


def _split(live: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over large components: what is left of them, and the centroids with their sums.

    There is at most one component for `NODES` nodes, so the tables with a row for each are small; Spark sees their size and picks the join.
    """
    top = ["top_conv", "top_depth"]
    half = F.col("below") * 2 >= F.col("total")
    centroids = (
        live.where(half).groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "below")).alias("c"))
        .select(*top, F.col("c.depth").alias("c_depth"), F.col("c.conv_id").alias("c_conv"), F.col("c.below").alias("c_below"))
    )
    # Nodes deeper than the centroid, by the path of their smallest member: is the centroid on it, and which child comes next?
    near = live.join(stored(centroids, "trie-centroids"), top)
    deep = near.where("depth > c_depth").join(owners, (F.col("path") == F.col("conv_id")) & (F.col("at") == F.col("c_depth") + 1), "left")
    under = F.coalesce(F.col("above") == F.col("c_conv"), F.lit(False))
    high = near.where("depth <= c_depth").withColumns(
        {"owner": F.lit(None).cast("bigint"), "under": (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv"))}
    )
    placed = deep.withColumn("under", under).drop("path", "at", "above").unionByName(high)
    placed = stored(placed, "trie-placed")
    totals = placed.where("under").groupBy(*top).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
    now = placed.join(totals, top)
    on_path = half & (F.col("depth") <= F.col("c_depth"))
    centroid = F.col("under") & (F.col("depth") == F.col("c_depth"))
    lower = F.col("under") & (F.col("depth") > F.col("c_depth"))
    now = stored(
        now.select(
            F.when(lower, F.col("owner")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(lower, F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            "conv_id", "depth", "parent_conv_id", "weight",
            F.when(on_path, F.col("below") - F.col("c_below")).otherwise(F.col("below")).alias("below"), "leaf", "saved",
            F.when(on_path, F.col("n_leaves") + F.col("t_leaf")).otherwise(F.col("n_leaves")).alias("n_leaves"),
            F.when(on_path, F.col("saved_tokens") + F.col("t_saved")).otherwise(F.col("saved_tokens")).alias("saved_tokens"),
            centroid.alias("given_up"),
        ),
        "trie-live",
    )
    return now.where("NOT given_up").select(*_STATE), now.where("given_up").select(*_ADDED)


def _small(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            t = np.stack([np.asarray(b.column(c).fill_null(-1)).astype(np.int64) for c in _STATE])
            held.append(t)
            n += t.shape[1]
            if n >= 2 * most:
                t = np.concatenate(held, axis=1)
                edges = np.flatnonzero((np.diff(t[0]) != 0) | (np.diff(t[1]) != 0))
                if len(edges):  # up to the last component, which may go on
                    cut = int(edges[-1]) + 1
                    yield _summed(t[:, :cut])
                    held, n = [t[:, cut:]], t.shape[1] - cut
                else:
                    held = [t]
        if n:
            yield _summed(np.concatenate(held, axis=1))

    return run


def _summed(state: np.ndarray) -> pa.RecordBatch:
    """Whole components, all nodes given up as centroids: the sums of every node."""
    at = {name: i for i, name in enumerate(_STATE)}
    order = np.lexsort((state[at["conv_id"]], state[at["depth"]]))
    s = {name: state[i][order] for name, i in at.items()}
    size = len(order)
    parent = _parents(s)
    place = _preorder(s, parent)
    order = np.argsort(place)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    s = {k: v[order] for k, v in s.items()}
    parent = np.where(parent[order] >= 0, rank[parent[order]], -1)
    below, start = s["below"].copy(), place[order]
    end = np.searchsorted(start, start + below)  # the subtree of i in its component is i to end[i], and nodes of other components between
    label = np.flatnonzero(parent < 0)[np.cumsum(parent < 0) - 1]
    live = np.arange(size)
    while len(live):
        mine = label[live]
        path = live[below[live] * 2 >= below[mine]]
        centroid = np.zeros(size, np.int64)
        np.maximum.at(centroid, label[path], path)  # the last on the path in this order
        c = centroid[mine]
        under = (live >= c) & (live < end[c])
        leaf, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(leaf, mine[under], s["leaf"][live[under]])
        np.add.at(saved, mine[under], s["saved"][live[under]])
        s["n_leaves"][path] += leaf[label[path]]
        s["saved_tokens"][path] += saved[label[path]]
        below[path] -= below[centroid[label[path]]].copy()
        low = live[under & (live != c)]
        if len(low):
            tops = low[parent[low] == centroid[label[low]]]
            group = label[low] * size
            tops = np.sort(label[tops] * size + tops)
            label[low] = tops[np.searchsorted(tops, group + low, side="right") - 1] % size
        live = live[live != c]
    return pa.record_batch([pa.array(s[c]) for c in _ADDED], names=_ADDED)


def _parents(s: dict[str, np.ndarray]) -> np.ndarray:
    """The place of each node's parent, -1 for tops. Nodes are in order of depth and name."""
    name = np.rec.fromarrays([s["depth"], s["conv_id"]], names="d,c")
    wanted = np.rec.fromarrays([s["depth"] - 1, s["parent_conv_id"]], names="d,c")
    top = (s["depth"] == s["top_depth"]) & (s["conv_id"] == s["top_conv"])
    found = np.searchsorted(name, wanted)
    return np.where(top, -1, np.minimum(found, len(found) - 1))


def _preorder(s: dict[str, np.ndarray], parent: np.ndarray) -> np.ndarray:
    """A place for each node before those of its subtree, which fill the `below` places from there on; component after component."""
    size = len(parent)
    by_parent = np.lexsort((np.arange(size), parent))
    sums = np.cumsum(s["below"][by_parent]) - s["below"][by_parent]
    group = np.searchsorted(parent[by_parent], parent[by_parent])  # the first of the same parent
    before = np.empty(size, np.int64)
    before[by_parent] = sums - sums[group]
    place = before.copy()
    levels = np.append(np.flatnonzero(np.diff(s["depth"], prepend=s["depth"][0] - 1)), size)
    for i, j in zip(levels[:-1], levels[1:], strict=True):
        inner = np.arange(i, j)[parent[i:j] >= 0]
        up = parent[inner]
        place[inner] = place[up] + s["weight"][up] + before[inner]
    return place


def ends(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: their ids in order, packed where they lie, then digested in a stream.

    A digest is made from the first byte to the last, so one task reads all ids of a node, however many; it holds one pack at a time.
    """
    last = paths.where("depth = len").select("key", "conv_id").unionByName(
        convs.where("len = 0").select(F.lit(_ROOT).alias("key"), "conv_id")
    )
    n = shuffle_partitions(convs.sparkSession)
    ranged = stored(last, "trie-ends").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    packs = ranged.mapInArrow(_packed, "key binary, first long, ids string")
    dealt = packs.repartition(n, "key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(_digested, "key binary, ends_sha256 string")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, first, ids, size = None, 0, [], 0
    for b in batches:
        out = []
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (k != key or size >= PACK):
                out.append((key, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = k, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield _batch(out, _PACK_ARROW)
    if ids:
        yield _batch([(key, first, ",".join(ids))], _PACK_ARROW)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for b in batches:
        out = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if digest is not None and k == key:
                digest.update(b",")
            else:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield _batch(out, _END_ARROW)
    if digest is not None:
        yield _batch([(key, digest.hexdigest())], _END_ARROW)


_PACK_ARROW = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_END_ARROW = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def trie(turns: DataFrame, most: int = NODES) -> DataFrame:
    """Every node of the prefix trie of `turns` (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first, equal ones by a digest of role and text; repeated turns count again. Null role and
    text are empty. A conversation begins with the first turns of the one its hundred begins with, as many as the CRC-32 of its id modulo
    6 says, and goes on with its own turns after as many. Turns without conv_id belong to no conversation and are left out. Remainders have
    the sign of the id. No turns give no node. Other columns are not looked at.
    """
    convs, rows = rebuilt(turns)
    paths = stored(prefixes(rows), "trie-paths")
    nodes = stored(_nodes(convs, paths), "trie-nodes")
    sums = rolled_up(paths, nodes, most)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(sums, ["conv_id", "depth"])
        .join(ends(convs, paths), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
