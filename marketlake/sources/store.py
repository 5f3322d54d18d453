"""Versioned Parquet tables: {root}/{layer}/{version}/{name}.

A write puts its files into a new folder below the table, and counts once a commit names that folder. Commits are rows of a table
beside it, `{name}_commits`; all rows of one commit lie in one file, which appears as a whole or not at all. A slot is a part of the table that
is replaced by itself: the newest commit of a slot holds, and a commit of the slot `*` replaces all older ones. Folders that no
commit names, as a write leaves that was killed midway, are never read. One writer at a time is assumed. A folder of plain Parquet
files without commits is a table too, if its writer has left its mark of success.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.schemas import COMMITS, LEDGER, RUNS

# The three layers.
LAYERS = ("raw", "processed", "features")

#: The slot of a commit that replaces the whole table.
WHOLE = "*"


def table_path(root: str, layer: str, name: str, version: str = "v1") -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}, choose from {list(LAYERS)}")
    return f"{root}/{layer}/{version}/{name}"


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system Spark finds `path`."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def current_parts(spark: SparkSession, path: str) -> list[Row] | None:
    """The commits that hold, one for each slot in order of time; None for a table without commits.

    There is a slot for each batch or bucket of a table, so this list is short however large the table.
    """
    if not exists(spark, f"{path}_commits"):
        return None
    log = spark.read.schema(COMMITS).parquet(f"{path}_commits")
    newest = log.groupBy("slot").agg(F.max(F.struct(*log.columns)).alias("c")).select("c.*").collect()
    whole = max((r["commit"] for r in newest if r["slot"] == WHOLE), default=0)
    return sorted((r for r in newest if r["commit"] >= whole), key=lambda r: (r["commit"], r["slot"]))


def write_part(df: DataFrame, path: str, partition: str | None = None) -> tuple[str, int]:
    """Writes `df` to a new folder of the table at `path`; the folder and how many rows went there. Nothing reads it before a commit."""
    folder, seen = uuid.uuid4().hex, Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/{folder}")
    return folder, seen.get.get("n", 0)


def commit(spark: SparkSession, path: str, parts: list[tuple[str, str | None, int]], ledger: bool = False) -> int:
    """Makes (slot, folder, rows) hold from now on, all at once; a folder of None empties its slot. Returns the commit's number."""
    held = current_parts(spark, path)
    number = max((r["commit"] for r in held or []), default=0) + 1
    rows = [(number, slot, folder, rows, ledger) for slot, folder, rows in parts]
    if held is None and _complete(spark, path) and all(slot != WHOLE for slot, _, _ in parts):
        rows.append((0, "plain", "", None, False))  # files written without commits stay a part of the table
    spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{path}_commits")
    return number


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether plain files were written to `path` to the end."""
    return exists(spark, f"{path}/_SUCCESS")


def read_parts(spark: SparkSession, path: str, parts: list[Row], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    folders = [f"{path}/{r['folder']}" for r in parts if r["folder"] is not None]
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema or T.StructType())


def load_table(
    spark: SparkSession,
    root: str,
    layer: str,
    name: str,
    version: str = "v1",
    schema: T.StructType | None = None,
) -> DataFrame:
    path = table_path(root, layer, name, version)
    parts = current_parts(spark, path)
    if parts is not None:
        return read_parts(spark, path, parts, schema)
    if not exists(spark, path):
        raise FileNotFoundError(f"no table {layer}/{version}/{name} below {root}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if _absent(error):
            raise FileNotFoundError(f"no table {layer}/{version}/{name} below {root}") from error
        raise


def table_exists(
    spark: SparkSession, root: str, layer: str, name: str, version: str = "v1"
) -> bool:
    """Whether the table has a commit, or plain files written to the end."""
    path = table_path(root, layer, name, version)
    return current_parts(spark, path) is not None or _complete(spark, path)


def load_or_build(
    spark: SparkSession,
    root: str,
    layer: str,
    name: str,
    build: Callable[[], DataFrame],
    version: str = "v1",
) -> DataFrame:
    """The stored table, built and stored first where it is missing or was left half written."""
    if not table_exists(spark, root, layer, name, version):
        path = table_path(root, layer, name, version)
        folder, rows = write_part(build(), path)
        commit(spark, path, [(WHOLE, folder, rows)])
    return load_table(spark, root, layer, name, version)


def save_ledger(spark: SparkSession, path: str, folder: str, schema: T.StructType) -> DataFrame:
    """Writes what a folder of bars holds by ticker, for the commit that follows; reads that folder only."""
    rows = spark.read.schema(schema).parquet(f"{path}/{folder}")
    _figures(rows).write.parquet(f"{path}_ledger/{folder}")
    return spark.read.schema(LEDGER).parquet(f"{path}_ledger/{folder}")


def ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(ticker, date_min, date_max, rows) of a stored table of bars, from what its writers noted. Only parts whose writer noted
    nothing are scanned. One row per ticker; the parts are those of now, whatever is committed later."""
    parts = [r for r in current_parts(spark, path) or [] if r["folder"] is not None]
    noted = [f"{path}_ledger/{r['folder']}" for r in parts if r["ledger"]]
    other = [r for r in parts if not r["ledger"]]
    found = spark.read.schema(LEDGER).parquet(*noted) if noted else spark.createDataFrame([], LEDGER)
    if other:
        found = found.unionByName(_figures(read_parts(spark, path, other, schema)))
    elif not parts and _complete(spark, path):
        found = _figures(spark.read.schema(schema).parquet(path))
    return found.groupBy("ticker").agg(
        F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"), F.sum("rows").alias("rows")
    )


def update_batches(spark: SparkSession, root: str, layer: str, name: str, version: str = "v1") -> DataFrame:
    """(batch, rows, files, bytes, updated): the parts of a stored table in order of commit, with the time of their newest file.

    From the commits and the file listing; one row per part. A table without commits is one part with unknown rows.
    """
    path = table_path(root, layer, name, version)
    held = current_parts(spark, path)
    parts = [(i, r["slot"], r["rows"]) for i, r in enumerate(held, 1)] if held is not None else [(1, "plain", None)]
    named = spark.createDataFrame(parts, "batch int, slot string, rows long")
    files = table_files(spark, root, layer, name, version).groupBy("slot").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("updated")
    )
    return named.join(files, "slot", "left").select(
        "batch", "rows", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "updated"
    )


def _figures(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count(F.lit(1)).alias("rows")
    )


def table_files(spark: SparkSession, root: str, layer: str, name: str, version: str = "v1") -> DataFrame:
    """(slot, path, modified, bytes) for each file of a stored table, from the file listing: no file is opened."""
    path = table_path(root, layer, name, version)
    parts = current_parts(spark, path)
    folders = [("plain", "")] if parts is None else [(r["slot"], r["folder"]) for r in parts if r["folder"] is not None]
    listed = None
    for slot, folder in folders:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{folder}")
        one = files.select(
            F.lit(slot).alias("slot"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")
        )
        listed = one if listed is None else listed.unionByName(one)
    if listed is None:
        return spark.createDataFrame([], "slot string, path string, modified timestamp, bytes long")
    return listed


def load_runs(spark: SparkSession, root: str, model_name: str | None = None) -> DataFrame:
    """Logged experiment runs in order of time, all or those of one model."""
    if exists(spark, f"{root}/runs"):
        runs = spark.read.schema(RUNS).parquet(f"{root}/runs")
    else:
        runs = spark.createDataFrame([], RUNS)
    if model_name:
        runs = runs.filter(F.col("model_name") == model_name)
    return runs.orderBy("created_at", "run_id")
