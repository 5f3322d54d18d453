"""Exact duplicates, with a hot text combined in steps and the full content compared in each.

Texts are equal when they are identical once blanks are deleted. Spark's hash aggregation first
combines equal texts within each task, then those of one salt, then the winners of the salts; each
time the whole normalised text is among the grouping keys, so two texts with the same digest stay
apart. The best row of a group is kept as one number, which hash aggregation can update in place:
the length in code points above the complement of the id.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm._tables import BLANKS, all_of, fresh, stored

SALTS = 16
TOP = (1 << 63) - 1
_RANK = "decimal(38,0)"


def normalised(text: Column) -> Column:
    """`text` without blanks; '' for null."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _number(value: int) -> Column:
    return F.lit(Decimal(value)).cast(_RANK)


def _rank(text: Column, doc_id: Column) -> Column:
    size = F.coalesce(F.length(text), F.lit(0)).cast("decimal(10,0)")
    high = size * F.lit(Decimal(1 << 64))
    low = F.lit(Decimal(TOP)) - doc_id.cast("decimal(20,0)")
    return (high + low).cast(_RANK)


def _winner(rank: Column) -> Column:
    return (_number(TOP) - F.pmod(rank, _number(1 << 64))).cast("bigint")


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per different content: sha, content, best (rank of the row that stays), size."""
    rows = docs.select(
        normalised(F.col("text")).alias("content"),
        _rank(F.col("text"), F.col("doc_id")).alias("best"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    salted = (
        rows.withColumn("sha", F.sha2("content", 256))
        .groupBy("sha", "salt", "content")
        .agg(F.max("best").alias("best"), F.count("*").alias("size"))
    )
    return (
        salted.repartition("sha")
        .groupBy("sha", "content")
        .agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    )


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row of `docs` (doc_id, ...) as doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Rows whose doc_id is null count in group_size and are never the
    one that stays, unless no row of the group has an id: then keep_id is null and all are kept. Rows that repeat
    doc_id and text of the one that stays are kept as well. Other columns are not looked at.
    """
    found = groups(docs, salts)
    # A digest with several contents gets one row for each; `other` counts them.
    digests = stored(
        found.groupBy("sha").agg(
            F.max("best").alias("best"), F.sum("size").alias("size"), F.count("*").alias("contents")
        ),
        "exact-groups",
    )
    shared = digests.where("contents > 1").select("sha")
    rows = docs.select("doc_id", normalised(F.col("text")).alias("content")).withColumn("sha", F.sha2("content", 256))
    alone = rows.select("doc_id", "sha").join(digests.where("contents = 1").drop("contents"), "sha")
    if not shared.isEmpty():  # different contents under one digest: told apart by the content itself
        apart = found.join(shared, "sha", "left_semi")
        alone = alone.unionByName(rows.join(apart, ["sha", "content"]).select("doc_id", "sha", "best", "size"))
    keep = _winner(F.col("best"))
    return alone.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("size").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.col("best").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, one for each content, with all their columns.

    A row that repeats both the id and the content of the one that stays goes too; if no row of a group
    has an id, one of them stays. Several texts under one id are separate documents.
    """
    sha, doc, sha2, times, content, long, row = fresh(docs, "sha", "doc", "sha2", "times", "content", "long", "row")
    found = exact_groups(docs, salts).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    kept = stored(
        found.select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha2), F.col("n").alias(times)), "exact-kept"
    )
    plain = normalised(F.col("text"))
    marked = docs.withColumn(sha, F.sha2(plain, 256)).join(
        kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(sha) == F.col(sha2))
    )
    several = F.col(times) > 1
    if kept.where(several).isEmpty():
        return marked.select(*all_of(docs))
    # The longest of the repeated rows, where they differ in blanks.
    ranked = marked.where(several).withColumn(content, plain).withColumn(long, F.length("text"))
    first = F.max_by(F.struct(*all_of(docs)), F.struct(long, "text")).alias(row)
    one = ranked.groupBy(doc, sha, content).agg(first).select(f"{row}.*")
    return marked.where(~several).select(*all_of(docs)).unionByName(one)
