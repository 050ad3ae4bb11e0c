"""Continuous ingest.

Packets are parsed with the same functions as in batch and appended by the file
sink, whose checkpoint makes restarts lose and repeat nothing.  There is no
watermark: a late point is accepted at any time and lands in its own hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseframe.session import parallelism
from pulseframe.sinks.segments import COMPRESSION, DEVICE_HOUR, raw_rows, with_day_hour, write_sparse
from pulseframe.sources.packets import packet_points, parse_packet_lines, parse_published

# Flush intervals.
SERVICE_INTERVAL = "10 seconds"
ARCHIVE_INTERVAL = "1 second"
SPARSE_INTERVAL = "30 seconds"

# Shuffle slots of a micro-batch per shuffle partition of the session.
SPARE_SLOTS = 8


def packet_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Packet JSONL files as they arrive; bad lines are skipped."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_packet_lines(reader.text(path), mode="skip")


def published_stream(spark: SparkSession, path: str) -> DataFrame:
    """Published packets arriving as files of one message per line."""
    return parse_published(spark.readStream.text(path))


def kafka_stream(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Published packets from Kafka (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", topics)
        .load()
    )
    return parse_published(raw.select(F.col("value").cast("string").alias("value")))


def _start(writer, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def _placed(rows: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a micro-batch dealt to its writers by partition.

    The batch is measured when it is shuffled: adaptive execution splits a partition
    above its advisory size over several tasks and leaves a small one in one file.  What
    shares a shuffle slot with a large one is split with it; spare slots make that rare,
    and empty ones are merged away.
    """
    return rows.hint("rebalance", SPARE_SLOTS * parallelism(rows.sparkSession), *partition_by)


def ingest_points(
    points: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = SERVICE_INTERVAL,
    tz: str = "UTC",
    partition_by: Sequence[str] = DEVICE_HOUR,
) -> StreamingQuery:
    """Append points to the long-row table; ``interval=None`` drains the source and ends."""
    rows = with_day_hour(points.select("device_id", "ts_ms", "param_id", F.col("value").cast("float").alias("value")), tz=tz)
    placed = _placed(rows, partition_by)
    writer = placed.writeStream.format("parquet").partitionBy(*partition_by).option("compression", COMPRESSION)
    return _start(writer, path, checkpoint, interval)


def ingest_packets(packets: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the points of parsed packets."""
    return ingest_points(packet_points(packets), path, checkpoint, **options)


def ingest_packet_wide(
    packets: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = SERVICE_INTERVAL,
    tz: str = "UTC",
    partition_by: Sequence[str] = DEVICE_HOUR,
) -> StreamingQuery:
    """Append parsed packets as one row each, with parallel lists."""
    rows = packets.where(F.size("points") > 0).select(
        "device_id",
        "ts_ms",
        F.col("points.param_id").alias("param_ids"),
        F.col("points.value").cast("array<float>").alias("values"),
    )
    placed = _placed(with_day_hour(rows, tz=tz), partition_by)
    writer = placed.writeStream.format("parquet").partitionBy(*partition_by).option("compression", COMPRESSION)
    return _start(writer, path, checkpoint, interval)


def archive_events(
    events: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = ARCHIVE_INTERVAL,
    tz: str = "UTC",
    partition_by: Sequence[str] = DEVICE_HOUR,
) -> StreamingQuery:
    """Append raw payloads by device, day and hour."""
    writer = (
        _placed(raw_rows(events, tz), partition_by)
        .writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("compression", COMPRESSION)
    )
    return _start(writer, path, checkpoint, interval)


def ingest_sparse(
    points: DataFrame,
    path: str,
    checkpoint: str,
    point_numbers: Sequence[int],
    interval: str | None = SPARSE_INTERVAL,
    partition_by: Sequence[str] = ("device_id", "year", "month", "day"),
) -> StreamingQuery:
    """Append points as one column per point, a folder per micro-batch below ``path``.

    A batch that runs again after a restart replaces its own folder.  Points of one time
    that arrive in different batches are rows of their own, as in the files of several
    flushes; the newest non-NULL value counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_sparse(batch, f"{path}/batch={batch_id:012d}", point_numbers, partition_by, mode="overwrite")

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def publish(rows: DataFrame, path: str, checkpoint: str, interval: str | None = SERVICE_INTERVAL) -> StreamingQuery:
    """Append message rows ``topic, key, value`` as JSON files."""
    return _start(rows.writeStream.format("json"), path, checkpoint, interval)
