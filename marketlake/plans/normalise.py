"""The index files into four raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.operators.index import dataset_summary
from marketlake.sinks.tables import save_table
from marketlake.sources.composition import (
    load_dividends,
    load_divisors,
    load_historical,
    load_spot,
)
from marketlake.sources.store import load_table


def normalise_all(
    spark: SparkSession,
    base: str,
    root: str,
    spot_file: str = "spot.csv",
    divisor_file: str = "divisores.csv",
    dividends_file: str = "dividendos.csv",
    version: str = "v1",
) -> DataFrame:
    """Parse and store composition, spot, dividends and divisor; returns a summary of each."""
    tables = {
        "composition": load_historical(spark, base),
        "spot": load_spot(spark, f"{base}/{spot_file}"),
        "dividends": load_dividends(spark, f"{base}/{dividends_file}"),
        "divisor": load_divisors(spark, f"{base}/{divisor_file}"),
    }
    for name, df in tables.items():
        save_table(df, root, "raw", name, version)
    return dataset_summary({name: load_table(spark, root, "raw", name, version) for name in tables})
