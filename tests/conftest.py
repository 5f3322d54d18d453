from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, name="tests")
    yield session
    session.stop()


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


@pytest.fixture
def make_bars(spark):
    """Bars from (ticker, date, open, close) rows; high and low follow, volume is 100."""

    def build(rows):
        full = [
            (
                day(d),
                o,
                max((x for x in (o, c) if x is not None), default=None),
                min((x for x in (o, c) if x is not None), default=None),
                c,
                100.0,
                t,
            )
            for t, d, o, c in rows
        ]
        schema = "date date, open double, high double, low double, close double, volume double, ticker string"
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def make_series(make_bars):
    """Bars of one ticker from closes on consecutive days."""

    def build(closes, ticker="AAA", start="2024-01-01"):
        first = day(start)
        return make_bars(
            [(ticker, str(first + datetime.timedelta(i)), c, c) for i, c in enumerate(closes)]
        )

    return build


@pytest.fixture
def series():
    """The values of one column in order of date."""

    def read(df, column, ticker=None):
        if ticker is not None:
            df = df.filter(df.ticker == ticker)
        return [r[column] for r in df.orderBy("date").collect()]

    return read
