"""Bars stored in buckets by ticker, so that what works ticker by ticker needs no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions import normal_ticker
from marketlake.schemas import OHLCV, OHLCV_COLUMNS
from marketlake.sources import store

BUCKETS = 64
_SLOT = "bucketed/"


def save_bucketed(bars: DataFrame, root: str, layer: str, name: str, version: str = "v1", buckets: int = BUCKETS) -> str:
    """Replace a stored table by `bars` in buckets of tickers, each one sorted file; returns the path of its files.

    Tickers are stored in upper case without blanks around them. A bucket holds whole tickers, and a ticker has no more bars than days, so the
    number of buckets should grow with that of the tickers. Files of the table can be read as any stored table.
    """
    spark, folder = bars.sparkSession, uuid.uuid4().hex
    path = store.table_path(root, layer, name, version)
    rows = bars.select(*OHLCV_COLUMNS[:-1], normal_ticker(F.col("ticker")).alias("ticker"))
    # Dealt and sorted as the files are cut, so that each bucket is written by one task to one file.
    laid_out = rows.repartition(buckets, "ticker").sortWithinPartitions("ticker", "date")
    writer = laid_out.write.format("parquet").option("path", f"{path}/{folder}")
    writer.bucketBy(buckets, "ticker").sortBy("ticker", "date").saveAsTable(_name(folder))
    store.commit(spark, path, [(store.WHOLE, None, 0), (f"{_SLOT}{buckets}", folder, None)])
    return f"{path}/{folder}"


def load_bucketed(spark: SparkSession, root: str, layer: str, name: str, version: str = "v1") -> DataFrame:
    """Bars stored by `save_bucketed`, by this session or another one, with their buckets known to Spark."""
    path = store.table_path(root, layer, name, version)
    parts = [p for p in store.current_parts(spark, path) or [] if p["folder"] is not None]
    if len(parts) != 1 or not parts[0]["slot"].startswith(_SLOT):
        raise FileNotFoundError(f"no bucketed table {layer}/{version}/{name} below {root}")
    table, buckets = _name(parts[0]["folder"]), int(parts[0]["slot"].removeprefix(_SLOT))
    if not spark.catalog.tableExists(table):  # stored by another session: its files are put under the same name here
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in OHLCV)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY (ticker) SORTED BY (ticker, date) INTO {buckets} BUCKETS LOCATION '{path}/{parts[0]['folder']}'"
        )
    return spark.table(table)


def _name(folder: str) -> str:
    return f"bars_{folder}"
