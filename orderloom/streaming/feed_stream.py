"""Change feeds applied as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.cow_table import BucketedTable


def apply_stream(changes: DataFrame, table_path: str, checkpoint: str, buckets: int = 64, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies each micro-batch to a bucketed table; a batch that is run again changes nothing.

    changes: a stream with the columns of a change feed. The table's manifest is
    committed before the stream's own, so after a failure the batch is applied
    anew, and versions make that a repeat. on_batch sees the batch first.
    """

    def one(batch: DataFrame, number: int) -> None:
        if on_batch:
            on_batch(batch, number)
        BucketedTable(batch.sparkSession, table_path, buckets).apply(batch)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(changes: DataFrame) -> DataFrame:
    """A running aggregate: the highest version per record, of that the first to arrive (update mode)."""
    best = F.max(F.struct("version", (-F.col("change_id")).alias("_first"), "payload")).alias("b")
    return changes.where("external_id IS NOT NULL AND version IS NOT NULL").groupBy("external_id").agg(best).select("external_id", "b.version", (-F.col("b._first")).alias("change_id"), "b.payload")


def new_versions(changes: DataFrame, stamp: str, late: str = "1 second") -> DataFrame:
    """The stream without repeats of (external_id, version) that come within ``late`` of each other."""
    return changes.withWatermark(stamp, late).dropDuplicatesWithinWatermark(["external_id", "version"])


def windowed_counts(events: DataFrame, stamp: str, key: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, events) of tumbling windows over an event stream."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), key, "events")
