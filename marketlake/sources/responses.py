"""Daily bars out of landed response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators.selection import canonical_bars
from marketlake.schemas import ENVELOPE, RESPONSES


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON record {"ticker": ..., "body": "..."} per line."""
    return spark.read.schema(RESPONSES).json(path)


def _readable(record: Column) -> Column:
    """Whether every date and number of a record can be parsed; missing ones are null, not bad."""
    good = record["d"].isNull() | F.try_to_date(F.substring(record["d"], 1, 10), "yyyy-MM-dd").isNotNull()
    for name in ("o", "h", "l", "c", "v"):
        good = good & (record[name].isNull() | record[name].try_cast("double").isNotNull())
    return good


def validated(responses: DataFrame) -> DataFrame:
    """Each response with its parsed envelope, and whether it is valid and readable.

    Valid is an object whose `series` is a list, empty or not; `noData` has no say in it. A valid
    response is readable if all of its records are, so that a bad one fails its ticker only.
    """
    parsed = F.from_json("body", ENVELOPE, {"mode": "PERMISSIVE"})
    series = F.col("envelope.series")
    return responses.withColumn("envelope", parsed).withColumns(
        {
            "valid": series.isNotNull(),
            "readable": F.coalesce(F.forall(series, _readable), F.lit(False)),
        }
    )


def as_numbers(checked: DataFrame) -> DataFrame:
    """(ticker, valid, readable, envelope) of validated responses, to be kept between steps: of the readable ones the fields that bars need, as numbers."""

    def record(r: Column) -> Column:
        numbers = [r[name].try_cast("double").alias(name) for name in ("o", "h", "l", "c", "v")]
        return F.struct(F.substring(r["d"], 1, 10).alias("d"), *numbers)

    series = F.struct(F.transform("envelope.series", record).alias("series"))
    return checked.select("ticker", "valid", "readable", F.when(F.col("readable"), series).alias("envelope"))


def bars_from_responses(responses: DataFrame) -> DataFrame:
    """Canonical bars of all readable responses; the ticker is the requested one."""
    return bars_of(validated(responses))


def bars_of(checked: DataFrame) -> DataFrame:
    """The same of responses that are validated already, so that no body is parsed twice."""
    return canonical_bars(checked.filter("readable").select("ticker", F.inline("envelope.series")))
