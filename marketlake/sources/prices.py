"""Reader of the alternative price file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.schemas import PRICE_LINES


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """The lines of comma-separated files with the columns ticker, date, open and close in any order, all as text.

    Other columns are left out. `operators.gaps.csv_rows` makes rows of the lines that can be read.
    """
    lines = spark.read.option("header", True).csv(path)
    missing = [c for c in PRICE_LINES.names if c not in lines.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return lines.select(*PRICE_LINES.names)
