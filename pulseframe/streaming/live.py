"""Stateful live views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseframe.functions.timeparts import event_time
from pulseframe.operators.latest import MERGE_GAP_MS


def hour_buckets(points: DataFrame, lateness: str | None = None) -> DataFrame:
    """Points per device and event-time hour, with the hour's value range.

    ``lateness`` sets a watermark; without one, late points are always counted
    (update or complete mode).
    """
    timed = points.withColumn("event_time", event_time(F.col("ts_ms")))
    if lateness is not None:
        timed = timed.withWatermark("event_time", lateness)
    return (
        timed.groupBy("device_id", F.window("event_time", "1 hour"))
        .agg(F.count("*").alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
        .select(
            "device_id",
            F.unix_millis("window.start").alias("hour_ms"),
            "points",
            "min_value",
            "max_value",
        )
    )


def merged_row_stream(
    updates: DataFrame, params: Sequence[str], gap_ms: int = MERGE_GAP_MS, lateness: str = "10 seconds"
) -> DataFrame:
    """Streaming form of row merging for known parameters.

    A session window closes ``gap_ms`` after its last update; an update exactly
    ``gap_ms`` later still merges.  Later values replace earlier ones.
    """
    timed = updates.withColumn("event_time", event_time(F.col("ts_ms"))).withWatermark("event_time", lateness)
    cells = [
        F.max_by(F.when(F.col("param_id") == p, F.col("value")), F.when(F.col("param_id") == p, F.struct("ts_ms", "value"))).alias(p)
        for p in params
    ]
    return (
        timed.groupBy("device_id", F.session_window("event_time", f"{gap_ms} milliseconds"))
        .agg(F.min("ts_ms").alias("label_ts"), F.max("ts_ms").alias("ts_ms"), *cells)
        .select("device_id", "label_ts", "ts_ms", *params)
    )


def upsert_view(view: DataFrame, path: str, checkpoint: str, interval: str | None = "10 seconds") -> StreamingQuery:
    """Keep a keyed view (update mode) as one versioned folder per micro-batch.

    Each batch holds the keys that changed; rewriting a batch after a restart
    replaces its own folder, so nothing is repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id:012d}"
        )

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        view.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def compact_view(stored: DataFrame, keys: Sequence[str], target: str) -> None:
    """Write only the newest version of every key, with its version, to a new place.

    Read it together with the batches that came later: ``latest_version`` of both is
    the view.
    """
    others = [c for c in stored.columns if c not in (*keys, "batch")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("now"))
    newest.select(*keys, "now.*").write.parquet(target)


def latest_version(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key of such a view."""
    others = [c for c in stored.columns if c not in (*keys, "version", "batch")]
    return (
        stored.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("now")).select(*keys, "now.*")
    )
