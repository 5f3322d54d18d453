from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.sources.store import WHOLE, commit, table_path, write_part


def _committed(df: DataFrame, path: str, mode: str) -> str:
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}, choose overwrite or append")
    folder, rows = write_part(df, path)
    commit(df.sparkSession, path, [(WHOLE if mode == "overwrite" else folder, folder, rows)])
    return f"{path}/{folder}"


def save_table(df: DataFrame, root: str, layer: str, name: str, version: str = "v1") -> str:
    """Replace a stored table at once when all is written; returns the path of the new files."""
    return _committed(df, table_path(root, layer, name, version), "overwrite")


def by_ticker(bars: DataFrame) -> DataFrame:
    """Bars laid out for files: a ticker's rows together and in order of date.

    Rebalancing cuts partitions that come out too large and merges small ones at run time,
    without a sampling pass.
    """
    return bars.hint("rebalance", F.col("ticker")).sortWithinPartitions("ticker", "date")


def save_bars(
    bars: DataFrame, root: str, layer: str, name: str, version: str = "v1", mode: str = "overwrite"
) -> str:
    """Store bars ordered by ticker and date, or add them to what is stored; returns the path of the new files.

    A filter on ticker skips most row groups, and no folder per ticker is needed however many
    tickers there are.
    """
    return _committed(by_ticker(bars), table_path(root, layer, name, version), mode)
