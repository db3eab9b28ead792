"""Daily session figures from a stream, with a bound on late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_session_kpis(sessions: DataFrame, late: str = "1 day") -> DataFrame:
    """Flagged and total claims per day; a day is emitted once no late row can reach it."""
    return (
        sessions.withWatermark("uploaded_at", late)
        .groupBy(F.window("uploaded_at", "1 day"))
        .agg(F.sum("fraud_detected").cast("long").alias("Flagged"), F.sum("total_rows").cast("long").alias("Total"))
        .select(F.to_date("window.start").alias("Date"), "Flagged", "Total")
    )
