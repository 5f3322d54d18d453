"""Running totals within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm._tables import shuffle_partitions, stored

_RANGE = "_range"


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> object:
    """Whether `columns` agree on both sides, null with null."""
    on = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        on = on & left[c].eqNullSafe(right[c])
    return on


def running(df: DataFrame, key: list[str], order: list[str], totals: dict[str, str], name: str) -> DataFrame:
    """`df` with a column for each of `totals` (new name: column): its sum over the earlier rows of the same key.

    Rows are dealt by range of key and order, so that a key with most of the rows is spread over tasks. A window adds up within
    each range. Only a key on the edge of a range can go on in another one: the sums of those keys, two for each shuffle
    partition at most, are added up across ranges and broadcast. `key` and `order` together must tell rows apart, or a tie may
    be told either way. `df` is computed twice, so it should be a scan or a stored table.
    """
    dealt = stored(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *key, *order).withColumn(_RANGE, F.spark_partition_id()), name
    )
    edge = F.struct(*key)
    ends = dealt.groupBy(_RANGE).agg(F.min(edge).alias("a"), F.max(edge).alias("b"))
    shared = (
        ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    ).select("k.*")
    inner = dealt.join(F.broadcast(shared), same(dealt, shared, key), "left_semi")
    sums = inner.groupBy(_RANGE, *key).agg(*[F.sum(c).alias(new) for new, c in totals.items()])
    earlier = Window.partitionBy(*key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col(_RANGE).alias("_r"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)],
        *[F.coalesce(F.sum(new).over(earlier), F.lit(0)).alias(f"_t{i}") for i, new in enumerate(totals)],
    )
    inside = Window.partitionBy(_RANGE, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumns({new: F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in totals.items()})
    on = here[_RANGE] == before["_r"]
    for i, c in enumerate(key):
        on = on & here[c].eqNullSafe(before[f"_k{i}"])
    added = {new: F.col(new) + F.coalesce(f"_t{i}", F.lit(0)) for i, new in enumerate(totals)}
    return here.join(F.broadcast(before), on, "left").withColumns(added).select(*df.columns, *totals)
