"""Partitioned Parquet tables.

Rows are rebalanced by partition key before the write: adaptive execution splits
a hot hour over several tasks (and files) and merges small ones, so neither a
single task nor thousands of tiny files result.  Sorting inside each output
partition gives row groups narrow parameter and time statistics.

Where small files are asked for, time goes by files, and a partition far below the size
at which it would be split may hold thousands.  Such rows are dealt in ranges of their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import timeparts
from pulseframe.operators.reshape import points_to_packets, sparse_wide
from pulseframe.schema import RAW_SCHEMA_VERSION
from pulseframe.sources.segments import read_table

# Default codec and rows per file.
COMPRESSION = "zstd"
ROWS_PER_FILE = 1_000_000
# Below so many rows, opening and closing a file outweighs what is in it.
SMALL_FILE_ROWS = 10_000
CODECS = ("zstd", "snappy", "gzip", "none")

DEVICE_HOUR = ("device_id", "day", "hour")


def with_day_hour(df: DataFrame, column: str = "ts_ms", tz: str = "UTC", compact_day: bool = False) -> DataFrame:
    """Add the partition columns ``day`` and ``hour``."""
    ts = F.col(column)
    return df.withColumn("day", timeparts.day_key(ts, tz, compact_day)).withColumn("hour", timeparts.hour_text(ts, tz))


def _write(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    sort_by: Sequence[str],
    compression: str,
    rows_per_file: int,
    mode: str,
) -> None:
    if compression not in CODECS:
        raise ValueError(f"unknown compression: {compression!r}")
    order = [*partition_by, *[c for c in sort_by if c not in partition_by]]
    # Equal ranges read the input twice; every writer leaves one short file a partition at either end of its range.
    dealt = df.repartitionByRange(*order) if rows_per_file < SMALL_FILE_ROWS else df.hint("rebalance", *partition_by)
    placed = dealt.sortWithinPartitions(*order)
    (
        placed.write.mode(mode)
        .partitionBy(*partition_by)
        .option("compression", compression)
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def write_long_rows(
    points: DataFrame,
    path: str,
    tz: str = "UTC",
    partition_by: Sequence[str] = DEVICE_HOUR,
    compression: str = COMPRESSION,
    rows_per_file: int = ROWS_PER_FILE,
    mode: str = "append",
) -> None:
    """One row per point, values narrowed to FLOAT, sorted by parameter and time.

    With very many devices, ``partition_by=("day", "hour")`` keeps files large;
    rows are then sorted by device first, so a device is still a narrow range of
    row groups.
    """
    rows = with_day_hour(points.select("device_id", "ts_ms", "param_id", F.col("value").cast("float").alias("value")), tz=tz)
    _write(rows, path, partition_by, ["device_id", "param_id", "ts_ms"], compression, rows_per_file, mode)


def write_packets(
    packets: DataFrame,
    path: str,
    tz: str = "UTC",
    partition_by: Sequence[str] = DEVICE_HOUR,
    compression: str = COMPRESSION,
    rows_per_file: int = ROWS_PER_FILE,
    mode: str = "append",
) -> None:
    """One row per packet: ``param_ids`` and ``values`` as parallel lists."""
    narrow = packets.select("device_id", "ts_ms", "param_ids", F.col("values").cast("array<float>").alias("values"))
    _write(with_day_hour(narrow, tz=tz), path, partition_by, ["device_id", "ts_ms"], compression, rows_per_file, mode)


def write_points_as_packets(points: DataFrame, path: str, **options) -> None:
    """Group points to packets, then write them."""
    write_packets(points_to_packets(points, "float"), path, **options)


def write_sparse(
    points: DataFrame,
    path: str,
    point_numbers: Sequence[int],
    partition_by: Sequence[str] = ("device_id", "year", "month", "day"),
    compression: str = COMPRESSION,
    rows_per_file: int = ROWS_PER_FILE,
    mode: str = "append",
) -> None:
    """One column per point, by device and day."""
    wide = sparse_wide(points, point_numbers)
    date = F.split(timeparts.day_key(F.col("timestamp")), "-")
    dated = wide.withColumns({"year": F.get(date, F.lit(0)), "month": F.get(date, F.lit(1)), "day": F.get(date, F.lit(2))})
    _write(dated, path, partition_by, ["device_id", "timestamp"], compression, rows_per_file, mode)


def raw_rows(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Events ``device_id, timestamp_ms, payload`` as archive rows with their day and hour."""
    rows = events.select(
        F.lit(RAW_SCHEMA_VERSION).cast("smallint").alias("schema_version"),
        "device_id",
        "timestamp_ms",
        F.col("payload").cast("binary").alias("payload"),
    )
    return with_day_hour(rows, "timestamp_ms", tz, compact_day=True)


def write_raw_archive(
    events: DataFrame,
    path: str,
    tz: str = "UTC",
    partition_by: Sequence[str] = DEVICE_HOUR,
    compression: str = COMPRESSION,
    rows_per_file: int = ROWS_PER_FILE,
    mode: str = "append",
) -> None:
    """Opaque payloads by device, day and hour."""
    _write(raw_rows(events, tz), path, partition_by, ["device_id", "timestamp_ms"], compression, rows_per_file, mode)


def compact_long_rows(
    spark: SparkSession,
    source: str,
    target: str,
    partition_by: Sequence[str] = DEVICE_HOUR,
    compression: str = COMPRESSION,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Rewrite a table of many small files as sorted, larger ones in a new place."""
    df = read_table(spark, source)
    _write(df, target, partition_by, ["device_id", "param_id", "ts_ms"], compression, rows_per_file, "errorifexists")
