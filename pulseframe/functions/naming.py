"""Segment and archive file names, path parts and composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name forms.
ARCHIVE_NAME = r"^h([0-9]+)_p([0-9]+)\.parquet\z"
ARCHIVE_NAME_LEGACY = r"^hour_([0-9]+)_part_([0-9]+)\.parquet\z"
SEGMENT_NAME = r"^seg_(?:.*_)?([0-9]+)\.parquet\z"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def archive_name(hour: Column, part: Column) -> Column:
    """``hHH_pNNN.parquet``."""
    return F.format_string("h%02d_p%03d.parquet", hour, part)


def archive_hour(name: Column) -> Column:
    """Hour in an archive file name (both forms); NULL when neither matches."""
    return F.coalesce(_number(name, ARCHIVE_NAME, 1), _number(name, ARCHIVE_NAME_LEGACY, 1))


def archive_part(name: Column) -> Column:
    """Part number in an archive file name (both forms)."""
    return F.coalesce(_number(name, ARCHIVE_NAME, 2), _number(name, ARCHIVE_NAME_LEGACY, 2))


def segment_sequence(name: Column) -> Column:
    """Sequence number at the end of a segment file name."""
    return _number(name, SEGMENT_NAME, 1)


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def _path_part(path: Column, from_end: int) -> Column:
    """Directory ``from_end`` levels above the file, without a ``name=`` prefix."""
    return F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-1 - from_end)), "^[^=]*=", "")


def path_device(path: Column) -> Column:
    """Device of ``…/device/day/hour/file``."""
    return _path_part(path, 3)


def path_day(path: Column) -> Column:
    """Day of ``…/device/day/hour/file``."""
    return _path_part(path, 2)


def path_hour(path: Column) -> Column:
    """Hour of ``…/device/day/hour/file``."""
    return _path_part(path, 1)


def path_device_of_day(path: Column) -> Column:
    """Device of ``…/device/day/file`` (the raw archive has no hour level)."""
    return _path_part(path, 2)


def path_day_of_device(path: Column) -> Column:
    """Day of ``…/device/day/file``."""
    return _path_part(path, 1)


def hourly_key(device_id: Column, day: Column, hour: Column) -> Column:
    """``device|day|HH``."""
    return F.concat_ws("|", device_id, day, F.lpad(hour.cast("string"), 2, "0"))
