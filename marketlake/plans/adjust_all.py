"""Raw bars into split-adjusted bars, for all tickers in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.operators.adjust import adjust_prices
from marketlake.plans.ingest import BARS
from marketlake.schemas import OHLCV, OHLCV_COLUMNS
from marketlake.sources import store

#: Processed bars lie in so many buckets by ticker; adjusting some tickers rewrites theirs alone.
BUCKETS = 64

_BUCKETED = T.StructType([*OHLCV.fields, T.StructField("bucket", T.IntegerType())])


def _bucket(ticker: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.upper(ticker)), F.lit(buckets)).cast("int")


def adjust_all(
    spark: SparkSession,
    root: str,
    splits: DataFrame,
    tickers: DataFrame | None = None,
    version: str = "v1",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Write the processed layer and return (ticker, ok, rows, reason).

    Every split applies and volume is multiplied; tickers without splits are copied. A requested
    ticker without raw bars fails. With `tickers` given, in any case, the processed bars of all other tickers stay: only the buckets
    of the named ones are written anew, with the other tickers' bars in them. Buckets are replaced all at once by one commit; a
    run that fails midway leaves the table as it was. A table that lies in another number of buckets, or in none, is written
    anew as a whole.
    """
    raw, path = store.load_table(spark, root, "raw", BARS, version, OHLCV), store.table_path(root, "processed", BARS, version)
    wanted, others, touched = None, None, list(range(buckets))
    if tickers is not None:
        wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
        raw = _of(raw, wanted, "left_semi")
        if store.table_exists(spark, root, "processed", BARS, version):
            parts = _parts(store.current_parts(spark, path), buckets)
            if parts is None:
                others = store.load_table(spark, root, "processed", BARS, version, OHLCV)
            else:  # no more than there are buckets
                touched = sorted(r[0] for r in wanted.select(_bucket(F.col("ticker"), buckets)).distinct().collect())
                others = store.read_parts(spark, path, [parts[b] for b in touched if b in parts], OHLCV)
            others = _of(others, wanted, "left_anti")
    adjusted = adjust_prices(raw, splits, index_only=False, volume_mode="multiply").select(*OHLCV_COLUMNS)
    if others is not None:
        adjusted = adjusted.unionByName(others.select(*OHLCV_COLUMNS))
    placed = adjusted.withColumn("bucket", _bucket(F.col("ticker"), buckets))
    laid_out = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "ticker", "date")
    folder, _ = store.write_part(laid_out, path, "bucket")
    rows = spark.read.schema(_BUCKETED).parquet(f"{path}/{folder}")
    counts = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per bucket
    slots = [(f"{b}/{buckets}", f"{folder}/bucket={b}" if b in counts else None, counts.get(b, 0)) for b in touched]
    store.commit(spark, path, slots if len(touched) < buckets else [(store.WHOLE, None, 0), *slots])
    return _status(rows, wanted)


def _parts(parts: list[Row] | None, buckets: int) -> dict[int, Row] | None:
    """The commit of each bucket; None if the table is not laid out in this number of buckets."""
    own = [r for r in parts or [] if r["slot"] != store.WHOLE or r["folder"] is not None]
    if parts is None or any(not r["slot"].endswith(f"/{buckets}") for r in own):
        return None
    return {int(r["slot"].split("/")[0]): r for r in own}


def _status(rows: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """What this run has written by ticker; `rows` are those of its own files."""
    totals = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("written"))
    if wanted is not None:
        totals = totals.groupBy(F.upper("ticker").alias("ticker")).agg(F.sum("written").alias("written"))
        totals = wanted.join(totals, "ticker", "left")
    n = F.coalesce("written", F.lit(0))
    return totals.select(
        "ticker",
        (n > 0).alias("ok"),
        n.alias("rows"),
        F.when(n > 0, "written").otherwise("no raw bars").alias("reason"),
    )


def _of(bars: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """The bars of the wanted tickers (left_semi) or of all others (left_anti)."""
    names = wanted.select(F.col("ticker").alias("_wanted"))
    return bars.join(names, F.upper(bars["ticker"]) == F.col("_wanted"), how)
