"""Joining facts to small tables without shuffling the facts.

A broadcast needs a bound on its size. Tables with one row per calendar date (or month, quarter, year) have one:
the DATE type has 3.65 million days between the years 1 and 9999, so a few doubles per date stay below 100 MB
whatever the number of facts; a real market history has some ten thousand days. Other joins are left to Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_by_date(facts: DataFrame, per_date: DataFrame, on: str = "date", how: str = "left") -> DataFrame:
    """Join to a table holding one row per date or year; a hot date costs no shuffle."""
    kind = per_date.schema[on].dataType.typeName()
    if kind not in ("date", "integer"):
        raise TypeError(f"{on} must be a DATE or a year, not {kind}: the calendar would not bound the broadcast")
    return facts.join(F.broadcast(per_date), on, how)
