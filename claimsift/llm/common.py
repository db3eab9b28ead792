"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.session import shared_folder

# Rows of a file of narrow rows.
FILE_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one; whoever owns that expires it."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there.

    ``files`` is the most files that it is written to, by as many tasks.
    """
    path = new_folder(df.sparkSession, label)
    df = df if files is None else df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_for(rows: int) -> int:
    """Files for so many narrow rows."""
    return max(1, -(-rows // FILE_ROWS))


def digest128(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def components(links: DataFrame, label: str) -> DataFrame:
    """``(id, component)`` for every id in ``links`` (a, b); the smallest id names it.

    Rounds of hooking and pointer jumping: every id looks at the smallest label
    around it, tells the label that it leaves, and labels are followed to their
    own labels. Each round is written to the shared folder once, to files by the
    number of links; the number of rounds grows with the logarithm of the
    longest chain of links. Hubs are met by partial aggregation before the
    shuffle, and their joins can be split at run time.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), f"{label}-links")
    files = files_for(both.count())
    first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    state = stored(first.select("id", F.least("id", "m").alias("component")), f"{label}-labels", files)
    while True:
        around = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
        near = state.join(around.agg(F.min("component").alias("near")), "id")
        new = F.least("component", "near")
        # An id's own new label, and the same for the label that it had.
        told = F.array(
            F.struct("id", F.col("component").alias("old"), new.alias("new")),
            F.struct(F.col("component").alias("id"), F.lit(None).cast("long").alias("old"), new.alias("new")),
        )
        hooked = near.select(F.inline(told)).groupBy("id").agg(F.max("old").alias("old"), F.min("new").alias("new"))
        jump = hooked.select(F.col("id").alias("new"), F.col("new").alias("next"))
        moved = (F.col("next") < F.col("old")).alias("moved")
        state = stored(hooked.join(jump, "new").select("id", F.col("next").alias("component"), moved), f"{label}-labels", files)
        if not state.where("moved").head(1):
            return state.select("id", "component")
        state = state.select("id", "component")
