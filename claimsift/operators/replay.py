"""Which requests a sliding-window limiter would have admitted.

An event is admitted when fewer than ``limit`` admitted events of its key lie
less than ``period`` before it; denied events do not count. The outcome
depends on earlier outcomes, so it is a fold, not a window frame. A pause of at
least ``period`` empties the window, so the events of a key are cut there into
segments that are folded apart, on different tasks.

A segment of up to ``FOLD_ROWS`` events is one sorted array that Spark's own
``aggregate`` folds. Longer ones, which no pause ends, are streamed sorted
through a Python worker, which keeps the last admitted times alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimsift.operators.lookup import attach_spread
from claimsift.session import materialize

# Events of a segment that is folded as one array.
FOLD_ROWS = 1_000
SECOND = 1_000_000
# Events without a time count as made at the start of year 1, before all others.
NO_TIME = -62_135_596_800 * SECOND

# Requests per period and period in seconds of the known endpoints.
LIMITS = {"login": (5, 60), "register": (3, 60), "ai_query": (10, 60)}


def segments(timed: DataFrame, period: int) -> DataFrame:
    """``(_slot, _segment, _rows, _size)``: the stretches of each key that no pause
    of ``period`` interrupts, with their number of events.

    Events are first reduced to slots one period wide. A pause as long as that
    cannot hide inside a slot, so the windows run over slots, not events.
    """
    slots = timed.groupBy("_slot", "_key").agg(
        F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count(F.lit(1)).alias("_rows")
    )
    in_time = Window.partitionBy("_key").orderBy("_from")
    pause = F.col("_from") - F.lag("_to").over(in_time)
    starts = slots.withColumn("_start", (pause.isNull() | (pause >= period)).cast("long"))
    numbered = starts.withColumn("_segment", F.sum("_start").over(in_time))
    size = F.sum("_rows").over(Window.partitionBy("_key", "_segment"))
    return numbered.withColumn("_size", size).select("_slot", "_segment", "_rows", "_size")


def folded(placed: DataFrame, columns: list[str], order: str, limit: int, period: int) -> DataFrame:
    """Short segments: their events as one sorted array, admitted by Spark's ``aggregate``."""
    event = F.struct("_t", F.col(order).alias("_order"), F.struct(*columns).alias("_event"))
    lists = placed.groupBy("_key", "_segment").agg(F.sort_array(F.collect_list(event)).alias("events"))

    def step(state: Column, x: Column) -> Column:
        held = F.filter(state["held"], lambda t: x["_t"] - t < period)
        allowed = F.size(held) < limit
        kept = F.when(allowed, F.concat(held, F.array(x["_t"]))).otherwise(held)
        return F.struct(kept.alias("held"), F.concat(state["out"], F.array(allowed)).alias("out"))

    start = F.struct(F.array().cast("array<long>").alias("held"), F.array().cast("array<boolean>").alias("out"))
    allowed = F.aggregate("events", start, step, lambda state: state["out"])
    both = F.arrays_zip(F.col("events").alias("events"), allowed.alias("allowed"))
    return lists.select(F.inline(both)).select("events._event.*", "allowed")


def admit(times: np.ndarray, rows: np.ndarray, allowed: np.ndarray, admitted: deque, limit: int, period: int) -> None:
    """Mark the admitted ones among sorted ``times`` and remember the last ``limit``.

    While the window is full, the events up to its next free moment are
    skipped by a search, so the work follows the admitted events.
    """
    at = 0
    while at < len(times):
        if len(admitted) == limit and times[at] - admitted[0] < period:
            at += int(np.searchsorted(times[at:], admitted[0] + period))
            continue
        allowed[rows[at]] = True
        admitted.append(times[at])
        at += 1


def fold(batches: Iterator[pd.DataFrame], limit: int, period: int) -> Iterator[pd.DataFrame]:
    """Admit or deny the sorted events of a partition, batch by batch.

    A segment may span batches: only its last admitted times are carried over.
    """
    current, admitted = None, deque(maxlen=limit)
    for batch in batches:
        times = batch["_t"].to_numpy()
        allowed = np.zeros(len(batch), dtype=bool)
        groups = batch.groupby(["_key", "_segment"], sort=False).indices
        for key, rows in sorted(groups.items(), key=lambda item: item[1][0]):
            if key != current:
                current = key
                admitted.clear()
            admit(times[rows], rows, allowed, admitted, limit, period)
        yield batch.assign(allowed=allowed)


def streamed(placed: DataFrame, columns: list[str], order: str, limit: int, period: int) -> DataFrame:
    """Long segments: sorted on disk and folded frame by frame in a Python worker."""
    arranged = placed.repartition("_key", "_segment").sortWithinPartitions("_key", "_segment", "_t", order)
    schema = T.StructType([*placed.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return fold(batches, limit, period)

    return arranged.mapInPandas(run, schema).select(*columns, "allowed")


def sortable(schema: T.StructType) -> bool:
    """Whether all columns can be ordered; maps and variants cannot."""
    return not any(word in schema.simpleString() for word in ("map<", "variant"))


def rate_limit_replay(
    events: DataFrame, keys: list[str], time: str, order: str, limit: int, period_seconds: int
) -> DataFrame:
    """Every event with ``allowed``; ``order`` breaks ties in time.

    The segments (a few figures for each key and period) are written first, as
    the longest decides whether a Python worker is needed at all. Their numbers
    return to the events by a lookup that spreads crowded slots.
    """
    period, columns = period_seconds * SECOND, events.columns
    timed = events.withColumns({"_key": F.to_json(F.struct(*keys)), "_t": F.coalesce(F.unix_micros(time), F.lit(NO_TIME))})
    slot = F.concat_ws("@", F.floor(F.col("_t") / F.lit(period)).cast("string"), "_key")
    timed = timed.withColumn("_slot", slot)
    numbered = materialize(segments(timed, period), "segments")
    longest = numbered.agg(F.max("_size")).first()[0] or 0
    placed = attach_spread(timed, numbered, "_slot", "_rows", F.col(order)).drop("_slot")
    if not sortable(events.schema):
        return streamed(placed.drop("_size"), columns, order, limit, period)
    short = folded(placed.where(F.col("_size") <= FOLD_ROWS).drop("_size"), columns, order, limit, period)
    if longest <= FOLD_ROWS:
        return short
    long = placed.where(F.col("_size") > FOLD_ROWS).drop("_size")
    return short.unionByName(streamed(long, columns, order, limit, period))
