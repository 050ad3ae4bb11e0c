"""History queries.

All take DataFrames of points (or packets, or raw rows) and return lazy
DataFrames.  On a table partitioned by day and hour the time range also prunes
directories, ``tz`` being the zone the table was keyed in; device, parameter and time
predicates reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulseframe.functions import text
from pulseframe.functions.codes import PARAM_CODE
from pulseframe.functions.timeparts import TimeRange
from pulseframe.operators import filters, ordering, reshape, unions
from pulseframe.operators.aggregates import source_counts
from pulseframe.sources.segments import sparse_point
from pulseframe.sources.skipping import candidate_files, candidates, open_files


def _scan(
    points: DataFrame, device_id: str, span: TimeRange, params: Sequence[str] | None, tz: str = "UTC"
) -> DataFrame:
    """``tz`` is the zone in which the table's day and hour were keyed."""
    wanted = (F.col("device_id") == device_id) & span.contains(F.col("ts_ms"))
    if {"day", "hour"} <= set(points.columns):
        wanted = filters.partition_predicate(span, tz) & wanted
    return filters.of_params(points.where(wanted), params)


def point_history(points: DataFrame, device_id: str, param: str, span: TimeRange, tz: str = "UTC") -> DataFrame:
    """One parameter of one device over time."""
    return ordering.by_time(filters.points_only(_scan(points, device_id, span, [param], tz)))


def params_history(
    points: DataFrame,
    device_id: str,
    span: TimeRange,
    params: Sequence[str] | None = None,
    tz: str = "UTC",
) -> DataFrame:
    """Several (or all) parameters of one device over time."""
    return ordering.by_time(filters.points_only(_scan(points, device_id, span, params, tz)))


def cold_history(
    points: DataFrame,
    device_id: str,
    span: TimeRange,
    params: Sequence[str] | None = None,
    limit: int = ordering.QUERY_LIMIT,
    tz: str = "UTC",
) -> DataFrame:
    """First rows of the stored history."""
    return ordering.first_rows(filters.points_only(_scan(points, device_id, span, params, tz)), limit)


@dataclass(frozen=True)
class UnifiedResult:
    """Rows of a unified query and their number per source."""

    rows: DataFrame
    counts: DataFrame


def unified_history(
    cold: DataFrame,
    hot: DataFrame,
    device_id: str,
    span: TimeRange,
    now_ms: int,
    params: Sequence[str] | None = None,
    limit: int | None = None,
    tz: str = "UTC",
    hot_tz: str | None = None,
) -> UnifiedResult:
    """Stored and recent rows as one history, split at the recent window's start.

    The recent rows are keyed in the same zone unless ``hot_tz`` names another.
    """
    boundary = unions.hot_boundary(now_ms)
    sides = [_scan(cold, device_id, span, params, tz), _scan(hot, device_id, span, params, hot_tz or tz)]
    both = unions.unified(*sides, span, boundary)
    columns = both.select("ts_ms", "param_id", "value", "source")
    rows = ordering.by_time(columns) if limit is None else ordering.first_rows(columns, limit)
    return UnifiedResult(rows, source_counts(both))


@dataclass(frozen=True)
class Page:
    """Rows of a page and the one-row total before paging."""

    rows: DataFrame
    total: DataFrame


def paged_history(
    catalog: DataFrame,
    packets: DataFrame,
    device_id: str,
    param: str,
    span: TimeRange,
    offset: int = 0,
    limit: int | None = None,
    tz: str = "UTC",
) -> Page:
    """One parameter, page by page, from segments the catalog does not rule out.

    ``catalog`` and ``packets`` share ``segment_file``.  Device and time prune the scan
    of packets; the semi join then drops what the catalog rules out.
    """
    code = _checked(device_id, param, span)
    held = candidates(catalog, device_id, span, code).select("segment_file").distinct()
    kept = _scan(packets, device_id, span, None, tz).join(held, "segment_file", "left_semi")
    return _param_page(kept, code, offset, limit)


def catalog_history(
    spark: SparkSession,
    catalog: DataFrame,
    root: str,
    schema: StructType,
    device_id: str,
    param: str,
    span: TimeRange,
    offset: int = 0,
    limit: int | None = None,
    tz: str = "UTC",
) -> Page:
    """One parameter, page by page, from the files of a table that the catalog does not rule out.

    ``catalog`` carries ``file_path`` (``skipping.file_catalog``, ``manifest_catalog``); files of
    the table at ``root`` that it rules out are not opened.  Long rows and packets both do.
    """
    code = _checked(device_id, param, span)
    table = open_files(spark, root, candidate_files(catalog, device_id, span, code), schema)
    return _param_page(_scan(table, device_id, span, None, tz), code, offset, limit)


def _checked(device_id: str, param: str, span: TimeRange) -> str:
    """The normalised code of a valid request."""
    code = param.strip().upper()
    if not device_id.strip():
        raise ValueError("device_id must not be empty")
    if re.search(PARAM_CODE.replace(r"\z", r"\Z"), code) is None:
        raise ValueError(f"invalid param_id: {param!r}")
    if span.empty:
        raise ValueError("from must not be after to")
    return code


def _param_page(rows: DataFrame, code: str, offset: int, limit: int | None) -> Page:
    points = rows if "param_id" in rows.columns else reshape.packets_to_points(rows)
    points = points.where(F.col("param_id") == code).select("ts_ms", "value")
    return Page(ordering.page(points, offset, limit, ("ts_ms", "value")), ordering.total_rows(points))


# Payload renderings of a raw query.
HEX, ASCII = "hex", "ascii"


def raw_history(
    raw: DataFrame,
    device_id: str,
    span: TimeRange,
    payload_format: str | None = None,
    limit: int | None = ordering.RAW_LIMIT,
    tz: str = "UTC",
) -> DataFrame:
    """Raw archive rows of one device with payload length and optional text.

    ``raw`` holds the rows of that device's files; a row of another device inside
    the range is an error.  Day and hour columns prune the scan; ``tz`` is their zone.
    """
    wanted = (F.col("timestamp_ms") >= 0) & span.contains(F.col("timestamp_ms"))
    if {"day", "hour"} <= set(raw.columns):
        wanted = filters.partition_predicate(span, tz) & wanted
    in_span = raw.where(wanted)
    foreign = F.raise_error(F.concat(F.lit("row of another device: "), F.col("device_id"))).cast("boolean")
    rows = in_span.where(F.when(F.col("device_id") == device_id, F.lit(True)).otherwise(foreign))
    shown = raw_rows(rows, payload_format).orderBy("ts_ms", "payload_len", "payload_text")
    return shown if limit is None else shown.limit(limit)


def raw_rows(raw: DataFrame, payload_format: str | None = None) -> DataFrame:
    """Time, device, payload length and payload text (empty unless asked for)."""
    payload = F.col("payload")
    rendered = {None: F.lit(""), HEX: text.hex_lower(payload), ASCII: text.printable_ascii(payload)}[payload_format]
    return raw.select(
        F.col("timestamp_ms").alias("ts_ms"),
        "device_id",
        F.octet_length(payload).alias("payload_len"),
        rendered.alias("payload_text"),
    )


def sparse_history(table: DataFrame, buffer: DataFrame, device_id: str, point: int, span: TimeRange) -> DataFrame:
    """One sparse point column from files and buffer; NULL where absent, repeats kept."""
    sides = [
        sparse_point(side, point, device_id, span.from_ms, span.to_ms).drop("device_id") for side in (table, buffer)
    ]
    return unions.all_rows(*sides).orderBy("timestamp", "value")


def wide_history(
    points: DataFrame, device_id: str, params: Sequence[str], span: TimeRange, tz: str = "UTC"
) -> DataFrame:
    """Wide table of one device: a column per parameter, NaN where absent, by time."""
    return reshape.wide_by_params(_scan(points, device_id, span, params, tz), params).orderBy("ts_ms")
