"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and S words in all takes every document T/S times on average: the whole part
surely, the rest by rounding. Two documents with fractions in hand compare: words of probability pass from one to
the other, in a direction drawn so that neither fraction changes on average, until one of them is 0 or 1. The other
goes on to the next. Words, not documents, are what passes, so a source's total stays at its target until
its very last document. Documents pair in order of falling size, so that one is small.

Rounding is a tree. The leaves are blocks of about `BLOCK` documents of one source and class of size; each sends its
one open document up, `FAN` blocks meet in the next level, and the classes of a source meet at the
root. A hot source only has more leaves. The last open document of a source goes to the nearer side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm._tables import all_of, fresh, running_totals, stored, words_of

BLOCK = 1024
FAN = 64
MOST = 3.0
#: Fractions nearer than this to 0 or 1 count as whole; it is far above what rounding of doubles adds up to.
WHOLE = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """source, source_size, target for sources (source, source_size).

    Sources by code point, null last, take `weights` in turn, and share the sum of all sizes by weight. None gets
    more than `most` times its size; what exceeds it is shared by the others. In order of size/weight those that
    reach their limit come first; the level of the rest is the first at which the next one stays below its limit.
    """
    ranked = running_totals(
        sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)),
        ["_null", "source"],
        "_one",
        "_rank",
        "mix-rank",
    )
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stored(
        ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * most).alias("limit"))
        .withColumn("ratio", F.col("limit") / F.col("weight")),
        "mix-sources",
    )
    # One after the other, so that neither is joined to the other.
    limits = running_totals(ranked, ["ratio", "source"], "limit", "limits_before", "mix-limits")
    weighed = running_totals(limits, ["ratio", "source"], "weight", "weights_before", "mix-weights")
    total = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w"))
    steps = weighed.join(F.broadcast(total)).withColumn(
        "level", (F.col("t") - F.col("limits_before")) / (F.col("w") - F.col("weights_before"))
    )
    level = stored(steps.where("ratio > level").agg(F.min_by("level", "ratio").alias("level")), "mix-level")
    return ranked.join(F.broadcast(level)).select(
        "source",
        "source_size",
        F.coalesce(
            F.when(F.col("ratio") > F.col("level"), F.col("level") * F.col("weight")), F.col("limit")
        ).alias("target"),
    )


def _draw(seed: int, place: int, a: str, b: str) -> float:
    return xxhash.xxh64_intdigest(f"{seed}/{place}/{a}/{b}") / 2.0**64


def pivot(keys: list, sizes: np.ndarray, parts: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds `parts` (0 to 1) until at most one is open; the rounded parts, and the place of the open one or -1."""
    parts, hand = parts.copy(), -1
    for i in range(len(parts)):
        if parts[i] <= WHOLE or parts[i] >= 1 - WHOLE:
            parts[i] = round(parts[i])
            continue
        if hand < 0:
            hand = i
            continue
        a, b = hand, i
        up = min((1 - parts[a]) * sizes[a], parts[b] * sizes[b])  # words that can pass from b to a
        down = min(parts[a] * sizes[a], (1 - parts[b]) * sizes[b])
        words = up if _draw(seed, i, keys[a], keys[b]) * (up + down) < down else -down
        parts[a] += words / sizes[a]
        parts[b] -= words / sizes[b]
        for x in (a, b):
            if parts[x] <= WHOLE or parts[x] >= 1 - WHOLE:
                parts[x] = round(parts[x])
        hand = next((x for x in (a, b) if 0 < parts[x] < 1), -1)
    return parts, hand


def _round_block(seed: int, last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "mix_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        keys = [f"{k}" for k in block["mix_key"]]
        parts, hand = pivot(keys, block["size"].to_numpy(float), block["part"].to_numpy(float), seed)
        if last and hand >= 0:
            parts[hand] = float(parts[hand] >= 0.5)
        block["part"] = parts
        return block

    return run


def copies(
    docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, row: str | None = None
) -> DataFrame:
    """How often the mix takes each row of `docs` (doc_id, text, source): mix_row, doc_id, source, size, source_size,
    target, copies.

    Sizes count words. Texts without words are taken 0 times; null is a source of its own; repeated rows are
    rounded separately. `row` may name a column of numbers that tell rows apart; it is handed through as mix_row. The draws depend on the seed,
    the ids and the sizes alone, so a rerun gives the same mix (rows equal in id and size may swap).
    """
    number = F.col(row) if row else F.lit(None)
    rows = stored(
        docs.select(number.cast("bigint").alias("mix_row"), "doc_id", "source", words_of(F.col("text")).alias("size")), "mix-rows"
    )
    # Powers of two of the size, four classes to each.
    rank = F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int")
    rows = rows.withColumn("class", rank)
    by_class = rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    by_class = stored(by_class, "mix-classes")
    wanted = stored(targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    blocks = by_class.select(
        F.col("source").alias("s"), F.col("class").alias("c"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("blocks")
    )
    plan = blocks.join(
        wanted.select(F.col("source").alias("s2"), "source_size", "target"), F.col("s").eqNullSafe(F.col("s2"))
    ).drop("s2")
    ready = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("rate", F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0))
        .withColumn("mix_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        .withColumn("block", F.pmod(F.xxhash64("mix_key", F.lit(seed)), F.col("blocks")))
        .withColumn("base", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("base"))
        .select(
            "mix_row", "doc_id", "source", "size", "source_size", "target", "mix_key", "base", "part", "class",
            F.col("block").cast("bigint").alias("block"),
        )
    )
    open_part = (F.col("part") > 0) & (F.col("part") < 1)
    top = by_class.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 1
    level = stored(ready.groupBy("source", "class", "block").applyInPandas(_round_block(seed, False), ready.schema), "mix-0")
    done = level.where(~open_part)
    depth = 1
    while top > 1:
        up = level.where(open_part).withColumn("block", F.floor(F.col("block") / FAN))
        level = stored(up.groupBy("source", "class", "block").applyInPandas(_round_block(seed + depth, False), ready.schema), "mix-up")
        done = done.unionByName(level.where(~open_part))
        top, depth = -(-top // FAN), depth + 1
    root = level.where(open_part).groupBy("source").applyInPandas(_round_block(seed + depth, True), ready.schema)
    return done.unionByName(root).select(
        "mix_row", "doc_id", "source", "size", "source_size", "target",
        (F.col("base") + F.col("part")).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """The mix itself: the rows of `docs`, with all their columns, each as often as it is taken."""
    row, again, times, copy = fresh(docs, "mix_row", "mix_again", "copies", "copy")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    taken = copies(rows, seed, weights, most, row).where("copies > 0")
    taken = taken.select(F.col("mix_row").alias(again), F.col("copies").alias(times))
    return (
        rows.join(taken, F.col(row) == F.col(again))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*all_of(docs))
    )
