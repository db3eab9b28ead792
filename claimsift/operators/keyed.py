"""Keyed set operations: which rows are new, which are known, which win.

Duplicates of a key are reduced by an aggregation before any join, so a key
that fills a third of a batch reaches the join as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimsift.operators import lookup, sketch
from claimsift.operators.features import spread_of
from claimsift.operators.lookup import attach_spread
from claimsift.schema import has
from claimsift.session import materialize


# A table with at most so many rows for one of the batch is not searched by a
# sketch of the batch: that would cost more than shuffling the table's keys.
NEAR = 4


def first_claim(df: DataFrame) -> list[Column | str]:
    """Order for batches that are appended: by claim id."""
    return ["TransactionID"] if has(df, "TransactionID") else []


def riskiest_claim(df: DataFrame) -> list[Column | str]:
    """Order for results that are upserted: highest risk, then claim id."""
    risk = [F.coalesce(-F.col("Risk_Score"), F.lit(float("inf")))] if has(df, "Risk_Score") else []
    return risk + first_claim(df)


def is_text(df: DataFrame, column: str) -> bool:
    """Whether a column is text already, so that ``_key`` made of it has its very values."""
    return df.schema[column].dataType == T.StringType()


def one_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order, and ``_copies`` of the key.

    ``order`` has columns' names and expressions. Ties are broken by the
    remaining columns. Rows without a key stay one group. Each value is
    shuffled once: a text key and columns of the order are not carried again.
    """
    told = [key] if is_text(df, key) else []
    named = [o for o in order if isinstance(o, str) and o not in told]
    held = [F.col(f"`{o}`") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order) if not isinstance(o, str) or o in named]
    held += [F.col(f"`{c}`") for c in df.columns if c not in (*told, *named)]
    first = [F.min(F.struct(*held)).alias("_first")] if held else []
    reduced = df.groupBy(F.col(f"`{key}`").cast("string").alias("_key")).agg(*first, F.count(F.lit(1)).alias("_copies"))
    given = [F.col("_key").alias(c) if c in told else F.col(f"_first.`{c}`") for c in df.columns]
    return reduced.select("_key", *given, "_copies")


def keys_of(target: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a table as text."""
    return target.select(F.col(key).cast("string").alias("_key")).where(F.col("_key").isNotNull()).distinct()


def owned_keys(target: DataFrame, key: str, own: Column | None) -> DataFrame:
    """``(_key, _own)`` of the rows of a table that have a key; ``_own`` tells whether ``own`` holds."""
    own = F.lit(False) if own is None else F.coalesce(own, F.lit(False))
    return target.select(F.col(key).cast("string").alias("_key"), own.alias("_own")).where(F.col("_key").isNotNull())


def found_keys(target: DataFrame, key: str, wanted: DataFrame, count: int, own: Column | None = None) -> DataFrame:
    """``(_key, _own)`` of those keys of ``target`` that are among ``wanted``.

    ``wanted`` is stored and has ``count`` keys. A small set is broadcast; of a
    larger one a sketch goes to the table, and only rows that pass it are
    shuffled. ``_own`` tells whether ``own`` holds in a row of the key.
    """
    keys = owned_keys(target, key, own)
    wanted = wanted.select("_key").where(F.col("_key").isNotNull())
    if count <= lookup.BROADCAST_ROWS:
        near = keys.join(F.broadcast(wanted), "_key", "left_semi")
    else:
        passed = sketch.members(keys, "_key", sketch.sketch(wanted, "_key", count), count)
        near = passed.groupBy("_key").agg(F.bool_or("_own").alias("_own")).join(wanted, "_key", "left_semi")
    return near.groupBy("_key").agg(F.bool_or("_own").alias("_own"))


def mark_known(reduced: DataFrame, target: DataFrame | None, key: str, own: Column | None = None) -> DataFrame:
    """Add ``_known`` and ``_stored`` to the rows of ``one_per_key``.

    ``_stored``: the target has the key already. ``_known``: it had it before
    this batch, that is, in a row for which ``own`` does not hold. ``reduced``
    is written first, as its size decides how it meets the target, and so are
    the keys found there: whatever is read of the marks later agrees, also once
    the target has changed. Without a target nothing is known.
    """
    reduced = materialize(reduced, "keys")
    if target is None:
        return reduced.withColumns({"_stored": F.lit(False), "_known": F.lit(False)})
    found = materialize(found_keys(target, key, reduced, reduced.count(), own), "known")
    if found.count() <= lookup.BROADCAST_ROWS:
        found = F.broadcast(found)
    return with_marks(reduced, found)


def with_marks(reduced: DataFrame, found: DataFrame) -> DataFrame:
    """``_stored`` and ``_known`` of the rows of ``one_per_key``, by the ``(_key, _own)`` that were found."""
    hit = F.col("_own").isNotNull()
    return reduced.join(found, "_key", "left").withColumns({"_stored": hit, "_known": hit & ~F.col("_own")}).drop("_own")


def is_near(target: DataFrame, rows: int) -> bool:
    """Whether a table is small beside a batch of so many rows, or of its size."""
    return target.count() <= NEAR * rows


def mark_keys(df: DataFrame, target: DataFrame, key: str, own: Column | None = None) -> DataFrame:
    """The marks and ``_copies`` of each key of a batch, without its rows, written.

    For a batch that can be read again and a target that is not much larger:
    of both the keys alone are shuffled, each once. Of a stored key nothing
    but the marks is wanted, so its ``_key`` is empty.
    """
    copies = one_per_key(df.select(F.col(f"`{key}`")), key, []).select("_key", "_copies")
    found = owned_keys(target, key, own).groupBy("_key").agg(F.bool_or("_own").alias("_own"))
    marked = with_marks(copies, found)
    return materialize(marked.withColumn("_key", F.when(F.col("_stored"), F.lit("")).otherwise(F.col("_key"))), "keys")


def fresh_rows(df: DataFrame, marked: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The rows an append inserts, by the marks that ``mark_keys`` made of the same batch."""
    fresh = accepted(marked.withColumn("_fresh", F.col("_key")))
    if fresh.count() <= lookup.BROADCAST_ROWS:
        df = df.join(F.broadcast(fresh), F.col(f"`{key}`").cast("string") == F.col("_fresh"), "left_semi")
        return one_per_key(df, key, order)
    return one_per_key(df, key, order).join(fresh, F.col("_key") == F.col("_fresh"), "left_semi")


def intake_counts(marked: DataFrame) -> DataFrame:
    """One row of counts; the four parts add up to ``total``."""
    keyless = F.col("_key").isNull()
    fresh = ~keyless & ~F.col("_known")

    def total(amount: Column, condition: Column | None = None) -> Column:
        picked = amount if condition is None else F.when(condition, amount)
        return F.coalesce(F.sum(picked), F.lit(0)).cast("long")

    copies = F.col("_copies")
    return marked.agg(
        total(copies).alias("total"),
        total(F.lit(1), fresh).alias("new"),
        total(copies, F.col("_known")).alias("skipped"),
        total(copies - 1, fresh).alias("in_batch_duplicates"),
        total(copies, keyless).alias("null_keys"),
    )


def accepted(marked: DataFrame) -> DataFrame:
    """The rows an append inserts: one per key the target lacks."""
    return marked.where(F.col("_key").isNotNull() & ~F.col("_stored")).drop("_key", "_copies", "_known", "_stored")


def with_known(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Every batch row with ``_known``: whether the target has its key.

    The join with the target works on distinct keys; its outcome goes back to
    the rows by a lookup that spreads hot keys.
    """
    reduced = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_key")).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    marks = mark_known(reduced, target, key).drop("_stored")
    keyed = batch.withColumn("_key", F.col(key).cast("string"))
    return attach_spread(keyed, marks, "_key", "_copies", spread_of(batch)).drop("_key")


def new_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks, duplicates kept; rows without a key fall out."""
    return with_known(batch, target, key).where(~F.col("_known")).drop("_known")


def skipped_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target has."""
    return with_known(batch, target, key).where("_known").drop("_known")


def keyed_union(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of both by key, the incoming row winning whole."""
    kept = target.join(keys_of(incoming, key), F.col(key).cast("string") == F.col("_key"), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merged(
    target: DataFrame,
    incoming: DataFrame,
    key: str,
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert or replace by key; columns the incoming rows lack stay as they are.

    ``incoming`` has one row per key (see ``one_per_key``) and no row without.
    Inserted rows take ``defaults`` for the columns they lack. Rows of the
    target without a key stay as they are. Where both have the key as text,
    ``_key`` holds it, and it is not shuffled a second time.
    """
    told = [key] if is_text(target, key) and is_text(incoming, key) else []
    shared = [c for c in target.columns if c in incoming.columns]
    new = incoming.select(
        F.col(key).cast("string").alias("_key"), F.struct(F.lit(True).alias("_is"), *[F.col(c) for c in shared if c not in told]).alias("_new")
    )
    kept = [F.col(c) for c in target.columns if c not in told]
    old = target.select(F.col(key).cast("string").alias("_key"), F.struct(F.lit(True).alias("_is"), *kept).alias("_old"))
    joined = old.join(new, "_key", "full_outer")
    defaults = defaults or {}
    columns = []
    for field in target.schema.fields:
        old_value = F.col(f"_old.`{field.name}`")
        if field.name in told:
            column = F.col("_key")
        elif field.name in shared:
            column = F.when(F.col("_new").isNotNull(), F.col(f"_new.`{field.name}`")).otherwise(old_value)
        else:
            default = defaults.get(field.name, F.lit(None))
            column = F.when(F.col("_old").isNotNull(), old_value).otherwise(default)
        columns.append(column.cast(field.dataType).alias(field.name))
    return joined.select(*columns)


def with_status(target: DataFrame, updates: DataFrame, key: str = "PatientID") -> DataFrame:
    """New investigation status by key; ids the target lacks are not inserted.

    ``updates`` has the key and ``Investigation_Status``; of several updates of
    one key the last by ``updated_at`` counts, or the greatest without times.
    """
    status = F.col("Investigation_Status")
    latest = F.max_by(status, F.struct("updated_at", status)) if has(updates, "updated_at") else F.max(status)
    changes = updates.groupBy(F.col(key).cast("string").alias("_key")).agg(latest.alias("_status"))
    current = F.col("Investigation_Status") if has(target, "Investigation_Status") else F.lit(None).cast("string")
    joined = target.join(changes, F.col(key).cast("string") == F.col("_key"), "left")
    return joined.withColumn("Investigation_Status", F.coalesce("_status", current)).drop("_key", "_status")
