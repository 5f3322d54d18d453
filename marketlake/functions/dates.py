from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range labels and how many calendar months they reach back.
PERIOD_MONTHS = {"3M": 3, "6M": 6, "1Y": 12, "3Y": 36}


def quarter_label(date: Column) -> Column:
    """`2024-Q1` for any day of that quarter."""
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def business_days(first: Column, last: Column) -> Column:
    """Monday-to-Friday days in [first, last], holidays not considered.

    Closed form, so the cost does not depend on the length of the range:
    five per whole week, plus the working days among the days left over.
    """
    days = F.date_diff(last, first) + 1
    rest = F.pmod(days, F.lit(7))
    start = F.weekday(first)
    whole_weeks = (days - rest) / 7
    before_weekend = F.least(F.greatest(5 - start, F.lit(0)), rest)
    after_weekend = F.greatest(rest - (7 - start), F.lit(0))
    return (whole_weeks * 5 + before_weekend + after_weekend).cast("long")


def period_start(as_of: datetime.date, label: str) -> Column | None:
    """First day of a trailing range; None for `MAX`, which has no lower bound."""
    if label == "MAX":
        return None
    if label not in PERIOD_MONTHS:
        raise ValueError(f"unknown range {label!r}, choose from {[*PERIOD_MONTHS, 'MAX']}")
    return F.add_months(F.lit(as_of), -PERIOD_MONTHS[label])
