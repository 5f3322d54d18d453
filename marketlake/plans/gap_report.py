"""The gap report: from stored bars to flagged alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators import gaps


def prepared_rows(
    bars: DataFrame, extra_csv: DataFrame | None = None, instrument: str | None = None, unique: bool = False
) -> DataFrame:
    """Usable rows, one per instrument and date, of all sources.

    `unique` states that the tickers of `bars` are in upper case, without blanks around them, and that there is one row per ticker and
    date. Tickers are then taken as they are, and without other sources rows are not compared with each other.
    """
    sources = [gaps.scan_rows(bars, canonical=unique)]
    if extra_csv is not None:
        sources.append(gaps.csv_rows(extra_csv))
    if instrument is not None:
        # Below the aggregate, so that the scan can skip other tickers.
        sources = [s.filter(F.col("instrument") == instrument.upper()) for s in sources]
    return gaps.first_seen(sources, unique)


def gap_report(
    bars: DataFrame,
    composition: DataFrame | None = None,
    extra_csv: DataFrame | None = None,
    instrument: str | None = None,
    threshold: float = gaps.THRESHOLD,
    context: bool = False,
    unique: bool = False,
) -> DataFrame:
    """Alerts with index membership, and on request the rows around each."""
    rows = prepared_rows(bars, extra_csv, instrument, unique)
    detect = gaps.detect_gaps_with_context if context else gaps.detect_gaps
    return gaps.flag_membership(detect(rows, threshold), composition)
