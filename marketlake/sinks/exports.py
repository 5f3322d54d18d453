from __future__ import annotations

from pyspark.sql import DataFrame

from marketlake.sinks.tables import by_ticker


def export_report(report: DataFrame, path: str) -> None:
    """The alert report as CSV with a header."""
    report.write.mode("overwrite").option("header", True).csv(path)


def export_bars(bars: DataFrame, path: str) -> None:
    """A CSV copy of the bars, ordered by ticker and date."""
    by_ticker(bars).write.mode("overwrite").option("header", True).csv(path)
