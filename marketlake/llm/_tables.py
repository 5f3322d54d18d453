"""Helpers on tables: stored intermediate results, running totals, connected components, files."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.plans.scratch import scratch_path

#: The characters that separate words; all else is part of a word.
BLANKS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until `df` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(df: DataFrame) -> list[Column]:
    """The columns of `df` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_file(folder: str, suffix: str) -> tuple[str, pyarrow.fs.FileSystem, str]:
    """A name for a new file in `folder` (a URI or a path), its file system, and its path there.

    The name is new for each attempt of a task: a repeated attempt never writes to a file that
    another one has open, and only files named in a committed manifest count.
    """
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, fs, path


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def running_totals(df: DataFrame, order: list[str], value: str, total: str, name: str) -> DataFrame:
    """Adds `total`, the sum of `value` over all rows before this one in `order`.

    Rows are dealt by range of `order`; a window adds up within each range, and a second one the
    sums of the ranges, of which there is one for each partition. No task sees all rows.
    """
    dealt = stored(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        name,
    )
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select(
        "_range",
        F.coalesce(
            F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(before), "_range")  # one row for each shuffle partition
        .withColumn(total, F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every id in `edges` (a, b); component is the smallest id reachable.

    Large-star and small-star steps in turn, each two shuffles of the remaining edges, until no edge
    changes. A hub's edges are folded by `min`, which combines before the shuffle. Both steps are stored:
    Spark keeps the plan of every job on the driver, and tells it anew after each shuffle.
    """
    now = stored(
        edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(),
        name,
    )
    mark = _mark(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where("v <> m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stored(small, name)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: how many there are, and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def words_of(text: Column) -> Column:
    """The number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
