"""Ingestion as a stream: batches of observations merged run by run, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthlake.sources.merge_table import MergeTable


def merge_stream(batches: DataFrame, table: MergeTable, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Merge each micro-batch of observations (with ``observed_at``) into the table, once each.

    A batch that comes again after a crash is found in the table's log, or starts
    from the version it started from before, see ``MergeTable``. Its time is
    that of its newest observation, so a repeated batch writes the same values.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("observed_at").alias("at")).first()["at"]
        if newest is not None:
            table.merge(batch.drop("observed_at"), f"{name}-{batch_id}", F.lit(newest), F.lit(f"run_{name}_{batch_id}"))

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window with a bound on lateness (beyond the reference)."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
