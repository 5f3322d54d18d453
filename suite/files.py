"""Queries that write files in the stored formats and read them back through the library."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators import gaps, models, quality
from marketlake.plans import adjust_all as adjust_plan
from marketlake.plans import ingest as ingest_plan
from marketlake.plans.gap_report import gap_report, prepared_rows
from marketlake.plans.normalise import normalise_all
from marketlake.plans.scratch import scratch_path
from marketlake.schemas import OHLCV, OHLCV_COLUMNS, PRICE_COLUMNS
from marketlake.sinks import export_bars, export_report, log_run, save_bars, save_table
from marketlake.sources import composition as files
from marketlake.sources import responses as landed
from marketlake.sources import store
from marketlake.sources.prices import read_price_csv
from marketlake.streaming.ingest import ingest_available
from suite import fixtures as fx
from suite.registry import query, rounded
from suite.series import ALL_ADJUSTED, RAW_OHLC

EARLIEST, LATEST = datetime.date(1990, 1, 1), datetime.date(2010, 12, 31)
BARS = f"SELECT date, {RAW_OHLC}, volume, ticker FROM ohlcv"


def _comma(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def _write_csv(df: DataFrame, path: str, folder: str | None = None, **options: object) -> None:
    """Semicolon CSV; with `folder`, one folder per value of that column, kept to few files."""
    if folder is not None:
        df = df.hint("rebalance", F.col(folder))
    writer = df.write.option("sep", ";").option("header", True).options(**options)
    (writer.partitionBy(folder) if folder else writer).mode("overwrite").csv(path)


def write_historical(spark, sf, base):
    named = F.concat(F.year("date").cast("string"), F.lit(".csv"))
    day = F.col("date").cast("string")
    df = fx.composition(spark, sf).select(
        "ticker",
        F.col("quantity").cast("string").alias("cantidades_vigentes"),
        F.col("close").cast("string").alias("close"),
        day.alias("fecha_cantidades_vigentes"),
        day.alias("fecha_precio"),
        named.alias("cartera_historica_file"),
    )
    _write_csv(df, f"{base}/Cartera Historica", "cartera_historica_file")


def _write_dated(df, path, folder, **options):
    named = F.concat(F.date_format("date", "yyyyMMdd"), F.lit(".csv"))
    rows = df.select(
        F.col("ticker").alias("contrato"), _comma(F.col("quantity")).alias("cantidad"), named.alias(folder)
    )
    _write_csv(rows, path, folder, **options)


def write_spot(spark, sf, path):
    df = fx.spot(spark, sf)
    _write_csv(df.select(F.col("date").cast("string").alias("fecha_precio"), _comma(F.col("value")).alias("valor")), path)


def write_divisor(spark, sf, path):
    df = fx.divisor(spark, sf)
    _write_csv(df.select(F.date_format("date", "dd/MM/yyyy").alias("fecha_divisor"), _comma(F.col("divisor")).alias("divisor")), path)


def write_dividends(spark, sf, path):
    amount = F.translate(F.format_number("amount", 3), ",.", ".,")
    df = fx.dividends(spark, sf).select(
        F.col("ticker").alias("Especie"),
        amount.alias("Monto"),
        F.date_format("date", "d/M/yyyy").alias("Fecha de Ajuste"),
        F.col("type").alias("tipo"),
    )
    _write_csv(df, path)


@query(
    "S1_historical_composition",
    "composition",
    "SELECT date, ticker, quantity, close, source FROM composition",
)
def s1(spark, sf):
    base = scratch_path(spark, "historical")
    write_historical(spark, sf, base)
    return files.load_historical(spark, base)


@query("S2_projected_composition", "projected", "SELECT * FROM projected")
def s2(spark, sf):
    base = scratch_path(spark, "projected")
    _write_dated(fx.projected(spark, sf), f"{base}/Cartera Proyectada", "proyectada_file", quoteAll=True)
    return files.load_projected(spark, base)


@query("S3_current_composition", "current_comp", "SELECT * FROM current_comp")
def s3(spark, sf):
    base = scratch_path(spark, "current")
    _write_dated(fx.current(spark, sf), f"{base}/Cartera Vigente", "nvas_cantidades_pre_split_file")
    return files.load_current(spark, base)


def _screened(spark, sf):
    """The projected files with faults: those of January have no full date in their name, in those of February one line in seven lacks its
    number, in those of March every fifth has a field too many."""
    month, rank = F.month("date"), F.crc32(F.col("ticker").cast("binary"))
    named = F.when(month == 1, F.concat(F.lit("last"), F.year("date"))).otherwise(F.date_format("date", "yyyyMMdd"))
    count = _comma(F.col("quantity"))
    line = F.when((month == 2) & (rank % 7 == 0), F.concat("ticker", F.lit(";many"))).when(
        (month == 3) & (rank % 5 == 0), F.concat("ticker", F.lit(";"), count, F.lit(";1;2"))
    )
    lines = fx.projected(spark, sf).select(
        F.coalesce(line, F.concat("ticker", F.lit(";"), count)).alias("value"), F.concat(named, F.lit(".csv")).alias("proyectada_file")
    )
    base = scratch_path(spark, "faulty")
    # One task writes the header and all lines of a file.
    files_ = lines.groupBy("proyectada_file").agg(F.concat_ws("\n", F.lit("contrato;cantidad"), F.collect_list("value")).alias("value"))
    files_.write.partitionBy("proyectada_file").text(f"{base}/Cartera Proyectada")
    return files.screened(spark, base, "proyectada")


_FAULTS = """
SELECT date, CASE WHEN month(date) = 1 THEN 'last' || year(date) ELSE strftime(date, '%Y%m%d') END || '.csv' AS file,
       CASE WHEN month(date) = 1 THEN 'no date in name'
            WHEN month(date) = 2 AND bool_or(ticker IN (SELECT ticker FROM picked WHERE rank % 7 = 0)) THEN 'unreadable number'
            WHEN month(date) = 3 AND bool_or(ticker IN (SELECT ticker FROM picked WHERE rank % 5 = 0)) THEN 'wrong number of fields' END AS reason
FROM projected GROUP BY date"""


_PICKED = """
SELECT ticker, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(ticker, ''), lambda x: ord(x)::BIGINT),
         lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) AS rank
FROM (SELECT DISTINCT ticker FROM projected)"""


@query(
    "S2_rejected_files",
    "projected",
    f"SELECT file, reason FROM (WITH picked AS ({_PICKED}) {_FAULTS}) WHERE reason IS NOT NULL",
)
def s2_rejected(spark, sf):
    rejected = _screened(spark, sf)[1]
    return rejected.select(F.regexp_extract("file", "proyectada_file=([^/]+)", 1).alias("file"), "reason")


@query(
    "S2_accepted_rows",
    "projected",
    f"""SELECT p.* FROM projected p JOIN (WITH picked AS ({_PICKED}) {_FAULTS}) f ON f.date = p.date WHERE f.reason IS NULL""",
)
def s2_accepted(spark, sf):
    return _screened(spark, sf)[0]


@query("S4_spot_series", "spot", "SELECT date, value FROM spot")
def s4(spark, sf):
    path = scratch_path(spark, "spot") + ".csv"
    write_spot(spark, sf, path)
    return files.load_spot(spark, path)


@query("S5_divisor_series", "divisor", "SELECT date, divisor FROM divisor")
def s5(spark, sf):
    path = scratch_path(spark, "divisor") + ".csv"
    write_divisor(spark, sf, path)
    return files.load_divisors(spark, path)


@query("S6_dividends", "dividends", "SELECT ticker, amount, date, type FROM dividends")
def s6(spark, sf):
    path = scratch_path(spark, "dividends") + ".csv"
    write_dividends(spark, sf, path)
    return files.load_dividends(spark, path)


def _land(responses: DataFrame, name: str) -> DataFrame:
    spark = responses.sparkSession
    path = scratch_path(spark, name)
    responses.write.json(path, compression="gzip")
    return landed.read_responses(spark, path)


@query("S7_response_bars", "ohlcv", BARS)
def s7(spark, sf):
    bodies = _land(fx.responses(spark, sf), "responses")
    return landed.bars_from_responses(bodies)


@query(
    "S7_response_validation",
    "trades",
    """SELECT ticker, right(ticker, 1) NOT IN ('1', '2', '3') AS valid
       FROM (SELECT DISTINCT ticker FROM trades)""",
)
def s7_validation(spark, sf):
    return landed.validated(fx.mixed_responses(spark, sf)).select("ticker", "valid")


@query("S8_load_table", "ohlcv", BARS)
def s8(spark, sf):
    root = scratch_path(spark, "store")
    save_table(fx.bars(spark, sf), root, "raw", "ohlcv")
    return store.load_table(spark, root, "raw", "ohlcv", schema=OHLCV)


@query("S9_list_tickers", "trades", "SELECT DISTINCT ticker FROM trades")
def s9(spark, sf):
    """The tickers of an ingested store, from its ledger."""
    root = scratch_path(spark, "store")
    ingest_plan.take_in(fx.bars(spark, sf), root)
    return quality.listed_tickers(ingest_plan.stored_ledger(spark, root))


@query(
    "S11_extra_csv_source",
    "ohlcv projected",
    """SELECT ticker AS instrument, date, open, close FROM ohlcv
       UNION ALL SELECT ticker, date, quantity, quantity FROM projected p
       WHERE NOT EXISTS (SELECT 1 FROM ohlcv o WHERE o.ticker = p.ticker AND o.date = p.date)""",
)
def s11(spark, sf):
    path = scratch_path(spark, "extra") + ".csv"
    extra = fx.projected(spark, sf).select(
        "date", F.col("quantity").alias("open"), F.col("quantity").alias("close"), F.lower("ticker").alias("ticker")
    )
    extra.write.option("header", True).csv(path)
    return prepared_rows(fx.bars(spark, sf), read_price_csv(spark, path))


@query("S15_load_or_build", "divisor", "SELECT date, divisor FROM divisor")
def s15(spark, sf):
    root = scratch_path(spark, "store")
    path = f"{root}/divisor.csv"
    write_divisor(spark, sf, path)
    for _ in range(2):  # built the first time, read the second
        df = store.load_or_build(spark, root, "raw", "divisor", lambda: files.load_divisors(spark, path))
    return df


@query(
    "S16_run_log",
    "ohlcv",
    """SELECT 'naive' AS model_name, h AS horizon,
              round((SELECT avg(abs(f - close)) FROM (SELECT close,
                CASE h WHEN 1 THEN lag(close, 1) OVER w WHEN 3 THEN lag(close, 3) OVER w ELSE lag(close, 5) OVER w END AS f
                FROM ohlcv WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE f IS NOT NULL), 4) AS mae
       FROM (VALUES (1), (3), (5)) AS v(h)""",
)
def s16(spark, sf):
    root = _logged_runs(spark, sf)
    return store.load_runs(spark, root, "naive").select(
        "model_name",
        F.variant_get("params", "$.horizon", "int").alias("horizon"),
        F.round(F.variant_get("metrics", "$.mae", "double"), 4).alias("mae"),
    )


def _logged_runs(spark, sf):
    """A run per horizon of the naive model, and one of another model."""
    root = scratch_path(spark, "runs")
    metrics = models.forecast_metrics(models.naive_forecasts(fx.bars(spark, sf)))
    for row in metrics.collect():  # one row per model and horizon
        log_run(spark, root, row["model"], {"horizon": row["horizon"]}, {"n": row["n"], "mae": row["mae"]})
    log_run(spark, root, "other", {}, {})
    return root


@query(
    "K7_log_run",
    "trades",
    """SELECT model_name, h AS horizon, CASE WHEN h IS NOT NULL THEN
                (SELECT CAST(sum(greatest(n - h, 0)) AS BIGINT) FROM (SELECT count(DISTINCT date) AS n FROM trades GROUP BY ticker)) END AS n,
              true AS has_id
       FROM (VALUES ('naive', 1), ('naive', 3), ('naive', 5), ('other', NULL)) AS v(model_name, h)""",
)
def k7(spark, sf):
    return store.load_runs(spark, _logged_runs(spark, sf)).select(
        "model_name",
        F.variant_get("params", "$.horizon", "int").alias("horizon"),
        F.variant_get("metrics", "$.n", "bigint").alias("n"),
        (F.length("run_id") > 0).alias("has_id"),
    )


@query("K1_save_bars", "ohlcv", BARS)
def k1(spark, sf):
    root = scratch_path(spark, "store")
    path = save_bars(fx.bars(spark, sf), root, "features", "ohlcv", "v2")
    return spark.read.schema(OHLCV).parquet(path)


_STATUS = """
SELECT {run} AS run, ticker, right(ticker, 1) NOT IN ('1', '2', '3') AS ok,
       CASE WHEN right(ticker, 1) IN ('1', '2', '3', '4') THEN 0 ELSE {rows} END AS rows,
       CASE WHEN right(ticker, 1) IN ('1', '2', '3') THEN 'invalid response'
            WHEN right(ticker, 1) = '4' THEN 'no rows in range' ELSE '{reason}' END AS reason
FROM ohlcv GROUP BY ticker"""


@query(
    "K2_ingest",
    "ohlcv",
    _STATUS.format(run=1, rows="count(*)", reason="written")
    + " UNION ALL "
    + _STATUS.format(run=2, rows="0", reason="already stored"),
)
def k2(spark, sf):
    bodies = _land(fx.mixed_responses(spark, sf), "responses")
    root = scratch_path(spark, "store")
    runs = [
        ingest_plan.ingest(bodies, root, EARLIEST, LATEST).withColumn("run", F.lit(i)) for i in (1, 2)
    ]
    return runs[0].unionByName(runs[1])


@query("K2_stream_ingest", "ohlcv", BARS)
def k2_stream(spark, sf):
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "store")
    bodies = fx.responses(spark, sf)
    for _ in range(2):  # the second run finds the same responses in a new file, already stored
        bodies.write.mode("append").json(landing, compression="gzip")
        bodies = landed.read_responses(spark, landing)  # those of the first file, not made again
        ingest_available(spark, landing, root, f"{root}/checkpoint").awaitTermination()
    return ingest_plan.stored_bars(spark, root)


@query(
    "K3_normalise_all",
    "composition spot dividends divisor",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS n_rows, {t} AS n_tickers, min(date) AS date_min, max(date) AS date_max FROM {n}"
        for n, t in [
            ("composition", "count(DISTINCT ticker)"),
            ("spot", "CAST(NULL AS BIGINT)"),
            ("dividends", "count(DISTINCT ticker)"),
            ("divisor", "CAST(NULL AS BIGINT)"),
        ]
    ),
)
def k3(spark, sf):
    return _normalised(spark, sf, scratch_path(spark, "store"))


def _normalised(spark, sf, root):
    base = scratch_path(spark, "index")
    write_historical(spark, sf, base)
    write_spot(spark, sf, f"{base}/spot.csv")
    write_divisor(spark, sf, f"{base}/divisores.csv")
    write_dividends(spark, sf, f"{base}/dividendos.csv")
    return normalise_all(spark, base, root)


@query(
    "K3_stored_tables",
    "composition spot dividends divisor",
    """SELECT 'composition' AS dataset, date, ticker, quantity AS a, close AS b, source AS label FROM composition
       UNION ALL SELECT 'spot', date, NULL, value, NULL, NULL FROM spot
       UNION ALL SELECT 'dividends', date, ticker, amount, NULL, type FROM dividends
       UNION ALL SELECT 'divisor', date, NULL, divisor, NULL, NULL FROM divisor""",
)
def k3_tables(spark, sf):
    """Every row of the four tables that the job has stored."""
    root = scratch_path(spark, "store")
    _normalised(spark, sf, root)
    columns = {
        "composition": ("ticker", "quantity", "close", "source"),
        "spot": (None, "value", None, None),
        "dividends": ("ticker", "amount", None, "type"),
        "divisor": (None, "divisor", None, None),
    }
    out = None
    for name, picked in columns.items():
        kinds = {"ticker": "string", "a": "double", "b": "double", "label": "string"}
        cells = [(F.col(c) if c else F.lit(None)).cast(t).alias(k) for c, (k, t) in zip(picked, kinds.items(), strict=True)]
        rows = store.load_table(spark, root, "raw", name).select(F.lit(name).alias("dataset"), "date", *cells)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "K4_adjust_all",
    "trades",
    """SELECT ticker, true AS ok, count(DISTINCT date) AS rows, 'written' AS reason FROM trades GROUP BY ticker
       UNION ALL SELECT 'NONE', false, 0, 'no raw bars'""",
)
def k4(spark, sf):
    root = scratch_path(spark, "store")
    save_bars(fx.bars(spark, sf), root, "raw", ingest_plan.BARS)
    asked = fx.trades(spark, sf).select("ticker").union(spark.range(1).select(F.lit("none")))
    return adjust_plan.adjust_all(spark, root, fx.splits(spark), asked)


@query(
    "K4_processed_bars",
    "ohlcv splits",
    ALL_ADJUSTED,
)
def k4_bars(spark, sf):
    """The processed bars after a full run that lacks the splits of some tickers, and a run that adds them for these alone."""
    root, splits = scratch_path(spark, "store"), fx.splits(spark)
    save_bars(fx.bars(spark, sf), root, "raw", ingest_plan.BARS)
    late = F.col("ticker").isin("S2", "S8")
    adjust_plan.adjust_all(spark, root, splits.filter(~late))
    adjust_plan.adjust_all(spark, root, splits, splits.filter(late).select(F.lower("ticker").alias("ticker")))
    out = store.load_table(spark, root, "processed", ingest_plan.BARS, schema=OHLCV)
    return rounded(out, *PRICE_COLUMNS, "volume", digits=8)


@query(
    "A16_run_totals",
    "trades",
    """SELECT count(*) FILTER (right(ticker, 1) NOT IN ('1', '2', '3')) AS n_ok,
              count(*) FILTER (right(ticker, 1) IN ('1', '2', '3')) AS n_failed, count(*) AS n_total
       FROM (SELECT DISTINCT ticker FROM trades)""",
)
def a16(spark, sf):
    root = scratch_path(spark, "store")
    return quality.run_totals(ingest_plan.ingest(fx.mixed_responses(spark, sf), root, EARLIEST, LATEST))


@query(
    "A16_failed_tickers",
    "trades",
    """SELECT DISTINCT ticker, 'invalid response' AS reason FROM trades WHERE right(ticker, 1) IN ('1', '2', '3')""",
)
def a16_failed(spark, sf):
    root = scratch_path(spark, "store")
    return quality.failed_tickers(ingest_plan.ingest(fx.mixed_responses(spark, sf), root, EARLIEST, LATEST))


@query(
    "A9_last_update",
    "ohlcv",
    """SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS batch, n AS rows, true AS has_files,
              CASE WHEN row_number() OVER (ORDER BY d) > 1 THEN true END AS newer
       FROM (SELECT date >= DATE '1998-01-01' AS d, count(*) AS n FROM ohlcv GROUP BY 1)""",
)
def a9_update(spark, sf):
    """The batches of an ingested table, from its commits and file listing: rows, files, and whether it is newer than the last."""
    root, early = scratch_path(spark, "store"), F.col("date") < F.lit(datetime.date(1998, 1, 1))
    bars = fx.bars(spark, sf)
    for part in (early, ~early):
        ingest_plan.take_in(bars.filter(part), root)
    before = F.lag("updated").over(Window.orderBy("batch"))  # one row per batch
    batches = store.update_batches(spark, root, "raw", ingest_plan.BARS)
    return batches.select("batch", "rows", (F.col("files") > 0).alias("has_files"), (F.col("updated") > before).alias("newer"))


@query(
    "A9_update_batches",
    "ohlcv",
    """SELECT CAST(1 AS INTEGER) AS batch, count(*) AS n, CAST(NULL AS BOOLEAN) AS newer FROM ohlcv WHERE date < DATE '1998-01-01' HAVING count(*) > 0
       UNION ALL
       SELECT 2, count(*), CASE WHEN (SELECT min(date) FROM ohlcv) < DATE '1998-01-01' THEN true END
       FROM ohlcv WHERE date >= DATE '1998-01-01' HAVING count(*) > 0""",
)
def a9_batches(spark, sf):
    """Two batches of one table: the rows of each, and whether its files are newer than those of the one before."""
    root, early = scratch_path(spark, "store"), F.col("date") < F.lit(datetime.date(1998, 1, 1))
    bars = fx.bars(spark, sf)
    save_bars(bars.filter(early), root, "raw", "ohlcv")
    save_bars(bars.filter(~early), root, "raw", "ohlcv", mode="append")
    stored = store.load_table(spark, root, "raw", "ohlcv")
    times = [quality.last_update(stored.filter(part)).scalar() for part in (early, ~early)]
    rows = stored.groupBy(F.when(early, 1).otherwise(2).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("newer", F.when(F.col("batch") == 2, times[1] > times[0]))


@query(
    "K5_report_file",
    "alerts",
    """SELECT instrument AS ticker, date_str AS fecha, tipo, variacion_pct, ratio_implicito,
              CAST(NULL AS VARCHAR) AS en_indice FROM alerts""",
)
def k5(spark, sf):
    path = scratch_path(spark, "report") + ".csv"
    export_report(gaps.report(gap_report(fx.bars(spark, sf), unique=True)), path)
    schema = "ticker string, fecha string, tipo string, variacion_pct double, ratio_implicito double, en_indice string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("K6_bars_export", "ohlcv", BARS)
def k6(spark, sf):
    path = scratch_path(spark, "export") + ".csv"
    export_bars(fx.bars(spark, sf).select(*OHLCV_COLUMNS), path)
    return spark.read.schema(OHLCV).option("header", True).csv(path)
