"""Parquet segments of every layout."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe import schema
from pulseframe.functions import naming
from pulseframe.functions.timeparts import SECOND_MS, TimeRange
from pulseframe.operators.filters import date_predicate, hour_overlaps

# After any time a day key can name.
_END_MS = (1 << 62) - 1

PARTITION_COLUMNS = ["device_id", "day", "hour"]


def _scale(ts_unit: str) -> int:
    return {"ms": 1, "s": SECOND_MS}[ts_unit]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table written by our own sinks; partition keys are strings.

    A session that infers partition types turns ``05`` into 5; that is undone.
    """
    df = spark.read.parquet(path)
    text = {}
    for name in ("device_id", "year", "month", "day", "hour"):
        if name in df.columns and df.schema[name].dataType != T.StringType():
            plain = F.col(name).cast("string")
            text[name] = F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain)
    return df.withColumns(text) if text else df


def read_foreign_tree(spark: SparkSession, root: str, files: Sequence[str] | None = None) -> DataFrame:
    """Every Parquet file below a foreign ``device/day/hour`` tree, with its path.

    Manifests and side files are skipped by the name filter.  ``files`` names the only
    ones to open, as a catalog lists them.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    found = reader.parquet(*[plain_path(f) for f in files]) if files else reader.parquet(root)
    if files is not None and not files:
        found = found.where("false")
    return found.withColumn("file_path", F.col("_metadata.file_path"))


_GLOB = re.compile(r"([{}\[\]*?\\^,])")


def plain_path(uri: str) -> str:
    """A path as scans spell it, as the reader takes it: not a URI, patterns not expanded."""
    return _GLOB.sub(r"\\\1", unquote(uri))


def _foreign(
    spark: SparkSession,
    root: str,
    scale: int,
    device_id: str | None,
    from_ms: int | None,
    to_ms: int | None,
    tz: str,
    files: Sequence[str] | None,
) -> DataFrame:
    """Rows of a foreign tree that may belong to a device and time range.

    Conditions on the path drop whole files before they are opened; files outside
    ``device/day/hour`` directories are kept.  The range test is on the stored column
    so that it reaches the scan; the cast comes after it.
    """
    df = read_foreign_tree(spark, root, files)
    path = F.col("_metadata.file_path")
    if device_id is not None:
        df = df.where(naming.path_device(path) == device_id)
    if from_ms is not None or to_ms is not None:
        span = TimeRange(0 if from_ms is None else from_ms, _END_MS if to_ms is None else to_ms)
        day, hour = naming.path_day(path), naming.path_hour(path)
        keyed = F.try_to_date(day, "yyyy-MM-dd").isNotNull() & hour.try_cast("int").isNotNull()
        df = df.where(F.coalesce(~keyed, F.lit(True)) | hour_overlaps(day, hour, span, tz))
    if from_ms is not None:
        df = df.where(F.col("ts") >= F.lit(-(-from_ms // scale)))
    if to_ms is not None:
        df = df.where(F.col("ts") <= F.lit(to_ms // scale))
    return df


def foreign_long_rows(
    spark: SparkSession,
    root: str,
    ts_unit: str = "ms",
    from_ms: int | None = None,
    to_ms: int | None = None,
    device_id: str | None = None,
    tz: str = "UTC",
    files: Sequence[str] | None = None,
) -> DataFrame:
    """Long rows of a foreign tree, of one device and time range where given.

    Unsigned 64-bit times arrive as DECIMAL(20,0).  ``tz`` is the zone of the day and
    hour directories; ``files`` (``skipping.candidate_files``) the only ones to open.
    """
    scale = _scale(ts_unit)
    return _foreign(spark, root, scale, device_id, from_ms, to_ms, tz, files).select(
        naming.path_device(F.col("file_path")).alias("device_id"),
        (F.col("ts").cast("bigint") * F.lit(scale)).alias("ts_ms"),
        "param_id",
        "value",
        "file_path",
    )


def foreign_packets(
    spark: SparkSession,
    root: str,
    ts_unit: str = "ms",
    from_ms: int | None = None,
    to_ms: int | None = None,
    device_id: str | None = None,
    tz: str = "UTC",
    files: Sequence[str] | None = None,
) -> DataFrame:
    """Packet-wide rows of a foreign tree, of one device and time range where given."""
    scale = _scale(ts_unit)
    return _foreign(spark, root, scale, device_id, from_ms, to_ms, tz, files).select(
        naming.path_device(F.col("file_path")).alias("device_id"),
        (F.col("ts").cast("bigint") * F.lit(scale)).alias("ts_ms"),
        "param_ids",
        "values",
        "file_path",
    )


def sparse_point(
    table: DataFrame,
    point: int,
    device_id: str | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """One point column of a sparse-wide table; NULL where the point is absent.

    Year, month and day columns prune the scan.
    """
    if not 1 <= point <= schema.MAX_POINT_COLUMNS:
        raise ValueError(f"point {point} is outside 1…{schema.MAX_POINT_COLUMNS}")
    conditions = [
        (device_id, F.col("device_id") == device_id),
        (from_ms, F.col("timestamp") >= from_ms),
        (to_ms, F.col("timestamp") <= to_ms),
    ]
    if {"year", "month", "day"} <= set(table.columns):
        table = table.where(date_predicate(from_ms, to_ms))
    for given, condition in conditions:
        table = table if given is None else table.where(condition)
    return table.select(
        "device_id", "timestamp", F.col(f"point_{point:04d}").alias("value")
    )


def read_raw_archive(spark: SparkSession, path: str) -> DataFrame:
    """Raw archive rows with their file; a wrong column type fails the read."""
    return (
        spark.read.schema(schema.RAW_ARCHIVE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )


def stored_file() -> Column:
    """Path of the file a scanned row comes from."""
    return F.col("_metadata.file_path")


def stored_row() -> Column:
    """Position of a scanned row in its file."""
    return F.col("_metadata.row_index")
