"""Claim ingest by micro-batch, with the same key rule as a batch append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimsift.sources.tables import ClaimStore


def without_repeats(claims: DataFrame, key: str, delay: str) -> DataFrame:
    """Streamed claims without keys that came in less than ``delay`` before.

    Spark's own state holds a key from its arrival for ``delay``, so it stays
    bounded, and no row counts as late. Of several rows of a key in one
    micro-batch any stays. Rows without a key are told apart by their columns.
    """
    row = F.concat(F.lit("row "), F.to_json(F.struct(*claims.columns)))
    name = F.coalesce(F.concat(F.lit("key "), F.col(key).cast("string")), row)
    marked = claims.withColumns({"_key": name, "_came": F.current_timestamp()})
    return marked.withWatermark("_came", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_came")


def ingest_stream(
    claims: DataFrame,
    store: ClaimStore,
    now: Column,
    checkpoint: str,
    table: str = "claims",
    trigger: dict | None = None,
    name: str = "ingest",
    within: str | None = None,
) -> StreamingQuery:
    """Append each micro-batch's new keys; a batch replayed after a failure adds nothing.

    Claims keep the micro-batch that brought them, ``name`` and its number, and
    its counts go to ``ingest_batches``: a micro-batch that failed after its
    write and is run again finds its own rows and reports the counts of its
    first run. ``name`` has to differ between streams into one store.
    ``within``, as "1 hour", lets repeats of a key that come in so soon go before
    they reach the store; the counts are of what is left then.
    ``trigger`` goes to the writer, as ``{"processingTime": "1 minute"}``;
    without one the query takes what there is and ends.
    """
    if within is not None:
        claims = without_repeats(claims, store.key(table), within)

    def take(batch: DataFrame, batch_id: int) -> None:
        label = f"{name}-{batch_id}"
        counts = store.append_new(table, batch, now, batch_id=label)
        # Spark also runs micro-batches without rows, to move a watermark on.
        if counts["total"]:
            store.record_batch(label, counts, now)

    return (
        claims.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
