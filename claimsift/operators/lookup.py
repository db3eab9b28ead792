"""Left lookups of per-key figures that survive hot keys.

``figures`` has one row per key. A plain shuffled join would send every row of
a hot key to one task. Here the hottest keys, whose number is limited, travel
by broadcast, and their rows (as well as rows without a key) are spread over
all tasks, so that the shuffled join only matches keys that are not hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimsift.session import materialize

# At most this many hot keys are broadcast; every other key holds fewer rows
# than each of them, hence less than 1/HOT_KEYS of the table.
HOT_KEYS = 100_000
# A key below this row count is never worth a special path.
HOT_ROWS = 200_000
# Largest figure table (rows) that is broadcast whole, after it was counted.
BROADCAST_ROWS = 1_000_000
# The same for rows that carry texts.
BROADCAST_WIDE_ROWS = 50_000


def hottest(figures: DataFrame, rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The hottest keys by row count, never more than ``HOT_KEYS`` of them."""
    return figures.where(F.col(rows) >= hot_rows).orderBy(F.desc(rows)).limit(HOT_KEYS)


def attach_spread(
    df: DataFrame,
    figures: DataFrame,
    key: str,
    rows: str,
    spread: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``figures`` on ``key``; ``rows`` is its row-count column.

    ``spread`` varies within a key and deals the rows of hot keys to tasks:
    they enter the shuffle under a stand-in key taken from it, which the join
    condition keeps from matching anything.
    """
    values = [c for c in figures.columns if c != key]
    key_type = df.schema[key].dataType
    hot = hottest(figures, rows, hot_rows).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = figures.select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    apart = F.col(key).isNull() | F.col("_hot").isNotNull()
    stand_in = F.xxhash64(spread, F.spark_partition_id()).cast(key_type)
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumns(
        {"_apart": apart, "_join_key": F.when(apart, stand_in).otherwise(F.col(key))}
    )
    joined = marked.join(cold, (F.col("_join_key") == F.col("_cold_key")) & ~F.col("_apart"), "left")
    kept = [F.col(c) for c in df.columns]
    found = [F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values if v != rows]
    return joined.select(*kept, *found)


def attach_counted(
    df: DataFrame,
    figures: DataFrame,
    key: str,
    rows: str,
    spread: Column,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join figures that usually are few: count them, then pick the join.

    ``figures`` must be stored already (see ``materialize``), so that counting
    reads file footers. A table over the bound takes the spread join.
    """
    if figures.count() <= broadcast_rows:
        values = [c for c in figures.columns if c not in (key, rows)]
        return df.join(F.broadcast(figures.drop(rows)), key, "left").select(*df.columns, *values)
    return attach_spread(df, figures, key, rows, spread)
