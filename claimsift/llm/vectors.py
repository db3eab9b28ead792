"""What the two vector searches share: clean rows, classes of equal vectors, and
blocks of neighbouring rows in an order that is made in Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimsift.llm.common import stored


def clean(vectors: DataFrame, quantise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(vec_id, vec)`` of the rows whose vector and components are neither null
    nor without a finite value. Rows without an id are left out; of rows with
    the same id the smallest vector stays. Shorter vectors end in zeros."""
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(finite)
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec"))))
    if quantise:
        rows = rows.withColumn("vec", F.transform("vec", quantise))
    elif narrow:
        rows = rows.withColumn("vec", F.col("vec").cast("array<float>"))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``(class_id, vec, members)``: equal vectors once, with the ``keep`` smallest
    ids of each, the first of which names the class. No query needs more of
    them. Each task lets only those few ids of a vector through."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    lists = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return lists.select(F.element_at("members", 1).alias("class_id"), "vec", "members")


def sample(rows: DataFrame, size: int) -> np.ndarray:
    """Up to ``size`` vectors, drawn by a hash of their ids."""
    drawn = rows.orderBy(F.xxhash64("class_id"), "class_id").limit(size).select("vec").collect()
    return np.array([r.vec for r in drawn], dtype=float) if drawn else np.zeros((0, 0))


def blocks(rows: DataFrame, group: str, order: list[str], size: int, label: str) -> DataFrame:
    """Add ``block``: rows of each ``group`` in ``order``, ``size`` to a block.

    Rows are dealt out by ranges and written; a row's rank is its place in its
    partition and the rows of the same group in the partitions before, of which
    there is one figure for each partition and group.
    """
    keys = [group, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = stored(placed, label)
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(group, "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    ranked = placed.join(F.broadcast(before), [group, "_part"])
    rank = F.col("_before") + F.col("_place") - F.col("_first")
    return ranked.withColumn("block", F.floor(rank / size).cast("long")).drop("_part", "_place", "_first", "_before")


def answers(found: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from the classes that were found.

    ``found`` has ``(query_class, class_id, score)``, each pair once at least;
    ``queries`` has ``(query_id, class_id)``. A query never finds itself; equal
    scores are ordered by ``vec_id``. ``k + 1`` classes hold the first k answers.
    """
    pairs = found.groupBy("query_class", "class_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    pairs = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    # Descending: a long's complement, as the smallest long has no opposite.
    down = F.bitwise_not("score") if found.schema["score"].dataType == T.LongType() else -F.col("score")
    rows = pairs.join(members.select("class_id", "members"), "class_id")
    rows = rows.select("query_class", F.explode("members").alias("vec_id"), "score")
    listed = rows.groupBy("query_class").agg(
        F.array_sort(F.collect_list(F.struct(down.alias("down"), "vec_id", "score"))).alias("list")
    )
    # A class with very many queries is split at run time.
    joined = queries.join(listed, queries["class_id"] == listed["query_class"])
    mine = F.filter("list", lambda x: x["vec_id"] != F.col("query_id"))
    top = joined.select("query_id", F.posexplode(F.slice(mine, 1, k)).alias("at", "x"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
