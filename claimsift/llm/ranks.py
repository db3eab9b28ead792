"""Numbering of rows within groups, made by ranges so that no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimsift.llm.common import stored


def numbered(rows: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """Add ``rank`` (from 0, in ``order`` within ``group``) and ``total``, the group's rows.

    ``group`` names columns without nulls. Rows are dealt by ranges of group and
    order, sorted and written; a row's rank is its place in its range and the
    rows of its group in the ranges before, of which there is one figure for
    each group and range. Only rows that are alike in group and order have to
    share a range; their ranks are given out in any order.
    """
    keys = [*[F.col(c) for c in group], *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = stored(placed, label)
    parts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    mine = Window.partitionBy(*group)
    upto = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        *group, "_part", (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("total")
    )
    return placed.join(parts, [*group, "_part"]).withColumn("rank", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
