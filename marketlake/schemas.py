"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

OHLCV_COLUMNS = ["date", "open", "high", "low", "close", "volume", "ticker"]
PRICE_COLUMNS = ["open", "high", "low", "close"]

OHLCV = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("ticker", T.StringType()),
    ]
)

COMPOSITION = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

# A line of the alternative price file, before anything is parsed.
PRICE_LINES = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "date", "open", "close")])

SPLITS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("in_index", T.BooleanType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("notes", T.StringType()),
    ]
)

MACRO_EVENTS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("tickers_affected", T.ArrayType(T.StringType())),
        T.StructField("direction", T.StringType()),
    ]
)

DIRTY_DATA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("expected_range", T.ArrayType(T.DoubleType())),
        T.StructField("notes", T.StringType()),
    ]
)

# One daily-bar response body of the market data service. Record fields stay text until they are
# cast, since numbers may arrive quoted.
ENVELOPE = T.StructType(
    [
        T.StructField("nextTime", T.StringType()),
        T.StructField("noData", T.BooleanType()),
        T.StructField(
            "series",
            T.ArrayType(
                T.StructType(
                    [T.StructField(k, T.StringType()) for k in ("c", "d", "h", "l", "o", "r", "sid", "v")]
                )
            ),
        ),
    ]
)

# A landed response: the requested ticker and the raw body text.
RESPONSES = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("body", T.StringType())]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("params", T.VariantType()),
        T.StructField("metrics", T.VariantType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# One part of a stored table, from the commit on that names it.
COMMITS = T.StructType(
    [
        T.StructField("commit", T.LongType()),
        T.StructField("slot", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("ledger", T.BooleanType()),
    ]
)

# What one part of the stored bars holds of a ticker.
LEDGER = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        T.StructField("rows", T.LongType()),
    ]
)
