"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `points` places on a ring of 64-bit hashes. A row goes to the first place clockwise of its own hash. A shard takes
rows in order of a second hash until it is full; those it can't take go on clockwise to the next place of a shard that is not
full, and so on. As each round that leaves rows over closes a shard, there are no more rounds than shards. With many places
few rows overflow, so another number of shards moves few rows besides those it must.

What a shard can take is found without sorting its rows: sums by the leading bits of the second hash show in which of `2**BITS`
parts the shard becomes full, sums by the next bits narrow that down, and only the rows of that small part are put in order.
DataFrame functions only. The ring and the sums by part have a size that the parameters fix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.llm._ranges import running, same
from marketlake.llm._tables import stored

SHARDS = 40
POINTS = 1024
#: The ring is looked up by so many leading bits; so are the sums that find where a shard becomes full.
BITS = 12

_OWN = ["doc_id", "size", "text_crc32"]
_ORDER = ["_turn", *_OWN, "_copy"]


def _part(hash_: str, level: int = 0) -> Column:
    return F.shiftrightunsigned(F.shiftleft(hash_, BITS * level), 64 - BITS)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, and _copy: the number of a row among those equal in all three."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    repeated = stored(rows.groupBy(*_OWN).agg(F.count("*").alias("_n")).where("_n > 1").select(*_OWN), "shard-repeated")
    alone = rows.join(repeated, same(rows, repeated, _OWN), "left_anti").withColumn("_copy", F.lit(0).cast("bigint"))
    if not repeated.isEmpty():
        several = stored(rows.join(repeated, same(rows, repeated, _OWN), "left_semi").withColumn("_one", F.lit(1)), "shard-several")
        alone = alone.unionByName(running(several, _OWN, ["_row"], {"_copy": "_one"}, "shard-copies").drop("_one"))
    return alone.drop("_row")


def hashed(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Adds _at, the place of a row on the ring, and _turn, its place in the order in which shards take rows."""
    return rows.withColumns({"_at": F.xxhash64(F.lit(seed), *_OWN, "_copy"), "_turn": F.xxhash64(F.lit(seed + 1), *_OWN, "_copy")})


def ring(spark: SparkSession, shards: int, points: int = POINTS, seed: int = 0) -> DataFrame:
    """(_shard, _place) for every virtual node. Those of a shard are the same however many shards there are."""
    ids = spark.range(shards * points).select((F.col("id") % shards).cast("int").alias("_shard"), F.floor(F.col("id") / shards).alias("k"))
    return ids.select("_shard", F.xxhash64(F.lit(seed), F.lit("ring"), "_shard", "k").alias("_place"))


def _cells(places: DataFrame) -> DataFrame:
    """For every value of the leading bits: the virtual nodes there in order, and the first one after them."""
    spark = places.sparkSession
    node = F.struct("_place", "_shard")
    full = places.groupBy(_part("_place").alias("_cell")).agg(F.array_sort(F.collect_list(node)).alias("_nodes"))
    every = spark.range(1 << BITS).select(F.col("id").alias("_cell")).join(full, "_cell", "left")
    # 2**BITS rows, whatever the data.
    first, back = F.get("_nodes", F.lit(0)), Window.orderBy(F.desc("_cell"))
    later = F.last(first, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    round_again = F.last(first, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return every.select("_cell", "_nodes", F.coalesce(later, round_again)["_shard"].alias("_after"))


def offer(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Adds `shard`, that of the first of `places` at or clockwise of each row."""
    cells = _cells(places)
    here = F.get(F.filter("_nodes", lambda x: x["_place"] >= F.col("_at")), F.lit(0))["_shard"]
    joined = rows.withColumn("_cell", _part("_at")).join(F.broadcast(cells), "_cell")
    return joined.withColumn("shard", F.coalesce(here, "_after")).drop("_cell", "_nodes", "_after")


def _of_shard(values: list[int]) -> Column:
    return F.expr(f"element_at(array({', '.join(f'{v}L' for v in values)}), shard + 1)")


def _held(offered: DataFrame, level: int, start: Column, room: Column) -> list:
    """For each shard: the sum of what it is offered, the part of the rows' order in which it becomes full (null if it
    doesn't), and what it holds before that part. One row for each shard."""
    sums = offered.groupBy("shard", _part("_turn", level).alias("part")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("held", start + F.sum("n").over(so_far))
    part, before = F.when(F.col("held") > room, F.col("part")), F.when(F.col("held") > room, F.col("held") - F.col("n"))
    return over.groupBy("shard").agg(F.sum("n").alias("n"), F.min(part).alias("part"), F.min(before).alias("before")).collect()


def assign(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, seed: int = 0) -> DataFrame:
    """Each row of `docs` (doc_id, text) with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is "rows": no two shards differ by more than one row. Slots number the rows of a shard from 0 without gaps, in an order of
    hashes. grown_shard is null, as full shards pass rows on and so doc_id alone doesn't decide. Null texts count as empty. Rows that
    repeat id and text are told apart by number and spread like others, null ids too. No rows give no rows. Other columns are not
    looked at.
    """
    if shards < 1 or points < 1:
        raise ValueError("shards and points must be positive")
    rest = stored(hashed(measured(docs), seed), "shard-hashed")
    rows = rest.count()
    room = [rows // shards + (k < rows % shards) for k in range(shards)]
    places, taken = ring(docs.sparkSession, shards, points, seed), None
    while rows:
        still = [k for k in range(shards) if room[k] > 0]
        offered = stored(offer(rest, places.where(F.col("_shard").isin(still))), "shard-offered")
        first = _held(offered, 0, F.lit(0), _of_shard(room))
        now, rest = _filled(offered, first, room)
        taken = now if taken is None else taken.unionByName(now)
        if all(r["part"] is None for r in first):
            break
        for r in first:
            room[r["shard"]] = room[r["shard"]] - r["n"] if r["part"] is None else 0
    placed = rest.withColumn("shard", F.lit(0)) if taken is None else taken
    placed = stored(placed.withColumn("_one", F.lit(1).cast("bigint")), "shard-placed")
    return running(placed, ["shard"], _ORDER, {"slot": "_one"}, "shard-slots").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _filled(offered: DataFrame, first: list, room: list[int]) -> tuple[DataFrame, DataFrame]:
    """The rows that shards take this round, and those left over."""
    part, before = _edges(first, len(room))
    if all(r["part"] is None for r in first):
        return offered, offered.limit(0)
    second = _held(offered.where(_part("_turn") == _of_shard(part)), 1, _of_shard(before), _of_shard(room))
    part2, before2 = _edges(second, len(room))
    at, edge = F.struct(_part("_turn"), _part("_turn", 1)), F.struct(_of_shard(part), _of_shard(part2))
    so_far = Window.partitionBy("shard").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    close = offered.where(at == edge).withColumn("_take", _of_shard(before2) + F.count("*").over(so_far) <= _of_shard(room))
    now = offered.where(at < edge).unionByName(close.where("_take").drop("_take"))
    left = offered.where(at > edge).unionByName(close.where("NOT _take").drop("_take"))
    return now, left.drop("shard")


def _edges(held: list, shards: int) -> tuple[list[int], list[int]]:
    """By shard the part in which it becomes full, one beyond all others if it takes all, and what it holds before."""
    full = {r["shard"]: (r["part"], r["before"]) for r in held if r["part"] is not None}
    both = [full.get(k, (1 << BITS, 0)) for k in range(shards)]
    return [p for p, _ in both], [b for _, b in both]
