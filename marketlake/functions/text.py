from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instrument code wraps the ticker in a market prefix and a settlement suffix.
INSTRUMENT_PREFIX = "bm_MERV_"
INSTRUMENT_SUFFIX = "_24hs"


def normal_ticker(ticker: Column) -> Column:
    return F.upper(F.trim(ticker))


def decimal_comma(text: Column, strict: bool = True) -> Column:
    """`12,5` as a double. Text that is no number fails the job when `strict`, else gives null."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return dotted.cast("double") if strict else dotted.try_cast("double")


def spanish_number(text: Column) -> Column:
    """`1.234,56` as a double: dots group thousands, the first comma is the decimal mark."""
    ungrouped = F.replace(text, F.lit("."), F.lit(""))
    return F.regexp_replace(ungrouped, r"^([^,]*),", "$1.").cast("double")


def instrument_id(ticker: Column) -> Column:
    return F.concat(F.lit(INSTRUMENT_PREFIX), ticker, F.lit(INSTRUMENT_SUFFIX))


def instrument_ticker(code: Column, strict: bool = True) -> Column:
    """The ticker inside an instrument code.

    A malformed code fails the job when `strict`, and gives null otherwise.
    """
    formed = code.startswith(INSTRUMENT_PREFIX) & code.endswith(INSTRUMENT_SUFFIX)
    inner = F.substring(
        code,
        len(INSTRUMENT_PREFIX) + 1,
        F.length(code) - len(INSTRUMENT_PREFIX) - len(INSTRUMENT_SUFFIX),
    )
    if strict:
        bad = F.raise_error(F.concat(F.lit("malformed instrument code: "), code))
    else:
        bad = F.lit(None)
    return F.when(formed, inner).when(code.isNotNull(), bad.cast("string"))
