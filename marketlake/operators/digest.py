"""Which days a table of facts holds, as bits: exact distinct counts that can be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 62 days of a year to a number, so that the sign stays free.
_BITS = 62
DAY_WORDS = [f"days{i}" for i in range(6)]


def days_digest(rows: DataFrame, key: str) -> DataFrame:
    """(key, year, n, days0 to days5): rows of each key and year, and a bit for each day of the year that has one.

    Keys and buffers are plain numbers, so the aggregate hashes, with map-side combine. There are as many rows as keys have years,
    whatever the number of facts. Rows without date count under the year null, without a day.
    """
    day = F.dayofyear("date") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (day % _BITS).cast("int"))
    zero = F.lit(0).cast("bigint")
    words = [
        F.bit_or(F.when(F.floor(day / _BITS) == i, bit).otherwise(zero)).alias(w) for i, w in enumerate(DAY_WORDS)
    ]
    return rows.groupBy(key, F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), *words)


def merged_digests(digests: DataFrame, key: str) -> DataFrame:
    """Digests of parts of a table, put together, into that of the whole."""
    return digests.groupBy(key, "year").agg(F.sum("n").alias("n"), *[F.bit_or(w).alias(w) for w in DAY_WORDS])
