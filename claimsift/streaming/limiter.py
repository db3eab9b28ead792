"""The sliding-window limiter of W01 over a stream, on Spark's own state.

Events may come late and in any order within a bound. An event waits in its
key's state until the watermark has passed it; then all earlier ones are there,
and the waiting events up to the watermark are admitted or denied in the order
of their times. Besides them a key's state has its last admitted times, never
more than ``limit``; a timer removes them once they can shut nothing out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimsift.operators.replay import SECOND, admit

# Fixed value: the store that keeps such state, on disk beside the executors and
# with every change in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MILLI = 1000
# An event's time as a number beside its columns. Names that begin with a line
# below do not reach the processor.
MICROS = "time_micros_"


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as Arrow's stream format."""
    batch = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Limiter(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then judges them."""

    def __init__(self, limit: int, period: int, order: str, columns: list[str]):
        self.limit, self.period, self.order, self.columns = limit, period, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.admitted = handle.getListState("admitted", T.StructType([T.StructField("t", T.LongType())]))
        # When the key is looked at next.
        self.due = handle.getValueState("due", T.StructType([T.StructField("milli", T.LongType())]))

    def look_again(self, milli: int) -> None:
        """Set the key's only timer."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(milli)
        self.due.update((milli,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendValue((packed(frame),))
                earliest = int(frame[MICROS].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            # The first millisecond that begins after the event.
            milli = first // MILLI + 1
            if not self.due.exists() or milli < self.due.get()[0]:
                self.look_again(milli)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        frames = [unpacked(bytes(data)) for (data,) in self.waiting.get()] if self.waiting.exists() else []
        times = [t for (t,) in self.admitted.get()] if self.admitted.exists() else []
        left, out = None, pd.DataFrame()
        if frames:
            rows = pd.concat(frames, ignore_index=True).sort_values([MICROS, self.order], kind="stable", ignore_index=True)
            ready = int(np.searchsorted(rows[MICROS].to_numpy(), watermark * MILLI))
            left, rows = rows.iloc[ready:], rows.iloc[:ready]
            allowed, kept = np.zeros(ready, dtype=bool), deque(times, maxlen=self.limit)
            admit(rows[MICROS].to_numpy(), np.arange(ready), allowed, kept, self.limit, self.period)
            out, times = rows[self.columns].assign(allowed=allowed), list(kept)
            self.waiting.clear()
            if len(left):
                self.waiting.put([(packed(left),)])
        times = [int(t) for t in times if t + self.period > watermark * MILLI]
        self.admitted.clear()
        if times:
            self.admitted.put([(t,) for t in times])
        if left is not None and len(left):
            self.look_again(max(int(left[MICROS].min()) // MILLI, watermark) + 1)
        elif times:
            self.look_again(max((times[-1] + self.period) // MILLI, watermark) + 1)
        yield out

    def close(self) -> None:
        pass


def limited(
    events: DataFrame, keys: list[str], time: str, order: str, limit: int, period_seconds: int, late: str = "1 minute"
) -> DataFrame:
    """Each streamed event with ``allowed``, once no earlier one can come any more.

    Events may be ``late`` behind the newest one seen; Spark leaves out those
    that are later still, as the answers that they would change are given. The
    last events of a stream wait until newer ones move the watermark on. Events
    without a time have no place among the others: they come out at once, not
    allowed. A key holds the events of ``late`` and of one micro-batch, in
    memory while they are judged; the source's ``maxFilesPerTrigger`` bounds it.

    The frame is written in append mode. The session's state store is set to
    the one that keeps such state; streams begun with another one keep theirs.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    columns = events.columns
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    timed = events.where(F.col(time).isNotNull()).withColumn("event_time_", F.col(time).cast("timestamp"))
    timed = timed.withColumn(MICROS, F.unix_micros("event_time_")).withWatermark("event_time_", late)
    judged = timed.groupBy(*keys).transformWithStateInPandas(
        Limiter(limit, period_seconds * SECOND, order, columns), schema, "Append", "EventTime"
    )
    return judged.unionByName(events.where(F.col(time).isNull()).withColumn("allowed", F.lit(False)))
