"""Readers of the semicolon-separated index files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.functions import decimal_comma, spanish_number
from marketlake.plans.scratch import written
from marketlake.schemas import COMPOSITION

# Where the three kinds of composition files lie below the base folder.
HISTORICAL_FILES = "Cartera Historica/cartera_historica_*.csv"
PROJECTED_FILES = "Cartera Proyectada/proyectada_*.csv"
CURRENT_FILES = "Cartera Vigente/nvas_cantidades*.csv"

_DATED = {"proyectada": PROJECTED_FILES, "vigente": CURRENT_FILES}
_MALFORMED = "_malformed"


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by header name."""
    return (
        spark.read.option("sep", ";").option("header", True).option("nullValue", "NA").csv(path)
    )


def load_historical(spark: SparkSession, base: str) -> DataFrame:
    """Daily composition with closing prices: date, ticker, quantity, close, source."""
    return _read(spark, f"{base}/{HISTORICAL_FILES}").select(
        F.to_date("fecha_precio", "yyyy-MM-dd").alias("date"),
        "ticker",
        F.col("cantidades_vigentes").cast("double").alias("quantity"),
        F.col("close").cast("double").alias("close"),
        F.lit("historica").alias("source"),
    )


def load_projected(spark: SparkSession, base: str) -> DataFrame:
    """Projected composition; the date comes from the file name."""
    return screened(spark, base, "proyectada")[0]


def load_current(spark: SparkSession, base: str) -> DataFrame:
    """Current composition, including the files issued before a split."""
    return screened(spark, base, "vigente")[0]


def _file_digits(pattern: str) -> Column:
    """The first eight digits in a row of the file name, '' when there are none.

    The name may belong to a folder of Spark part files instead of a single file.
    """
    stem = pattern.rsplit("/", 1)[1].split("*")[0]
    name = rf"^.*/{stem}[^/]*?(\d{{8}})[^/]*(?:/part-[^/]*)?$"
    return F.regexp_extract("_metadata.file_path", name, 1)


def _dated_rows(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Every line of the files with what is wrong with it, read once and kept in the scratch folder; None without files."""
    try:
        header = _read(spark, pattern).columns
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _MALFORMED]])
    lines = (
        spark.read.schema(schema)
        .options(sep=";", header=True, nullValue="NA", mode="PERMISSIVE", columnNameOfCorruptRecord=_MALFORMED)
        .csv(pattern)
    )
    quantity = decimal_comma(F.col("cantidad"), strict=False)
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"),
        _file_digits(pattern).alias("digits"),
        F.col("contrato").alias("ticker"),
        quantity.alias("quantity"),
        F.col(_MALFORMED).isNotNull().alias("malformed"),
        (F.col("cantidad").isNotNull() & quantity.isNull()).alias("unreadable"),
    )
    return written(rows, "composition")


def screened(spark: SparkSession, base: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the accepted files of a source, proyectada or vigente, and (file, reason) of the files left out.

    A file goes as a whole: if its name has no date, a line of it has too many or too few fields, or a quantity can't be read.
    The files are read at once, and once for both results; what is wrong by file is one aggregate over the kept lines.
    """
    rows = _dated_rows(spark, f"{base}/{_DATED[source]}")
    if rows is None:
        return spark.createDataFrame([], COMPOSITION), spark.createDataFrame([], "file string, reason string")
    per_file = rows.groupBy("file").agg(
        F.bool_or(F.col("digits") == "").alias("undated"),
        F.bool_or("malformed").alias("malformed"),
        F.bool_or("unreadable").alias("unreadable"),
    )
    reason = (
        F.when(F.col("undated"), "no date in name")
        .when(F.col("malformed"), "wrong number of fields")
        .when(F.col("unreadable"), "unreadable number")
    )
    rejected = per_file.select("file", reason.alias("reason")).filter(F.col("reason").isNotNull())
    accepted = rows.join(rejected.select("file"), "file", "left_anti").select(
        F.to_date("digits", "yyyyMMdd").alias("date"), "ticker", "quantity", F.lit(source).alias("source")
    )
    return accepted, rejected


def rejected_files(spark: SparkSession, base: str, source: str) -> DataFrame:
    """Files that `load_projected` or `load_current` leave out, and why."""
    return screened(spark, base, source)[1]


def load_composition(spark: SparkSession, base: str, source: str) -> DataFrame:
    """The composition of one kind: historica, proyectada or vigente."""
    match source:
        case "historica":
            return load_historical(spark, base)
        case "proyectada":
            return load_projected(spark, base)
        case "vigente":
            return load_current(spark, base)
    raise ValueError(f"no composition is called {source!r}")


def load_spot(spark: SparkSession, path: str) -> DataFrame:
    """Index values: date, value."""
    return _read(spark, path).select(
        F.to_date("fecha_precio", "yyyy-MM-dd").alias("date"),
        decimal_comma(F.col("valor")).alias("value"),
    )


def load_divisors(spark: SparkSession, path: str) -> DataFrame:
    """Index divisors: date, divisor."""
    return _read(spark, path).select(
        F.to_date("fecha_divisor", "d/M/yyyy").alias("date"),
        decimal_comma(F.col("divisor")).alias("divisor"),
    )


def load_dividends(spark: SparkSession, path: str) -> DataFrame:
    """Dividend events: ticker, amount, date, type (EF, AC or BONOS)."""
    return _read(spark, path).select(
        F.col("Especie").alias("ticker"),
        spanish_number(F.col("Monto")).alias("amount"),
        F.to_date("`Fecha de Ajuste`", "d/M/yyyy").alias("date"),
        F.col("tipo").alias("type"),
    )
