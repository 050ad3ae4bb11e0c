"""Predicates on points, packets, segments and partition columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import codes, topics
from pulseframe.functions.timeparts import SECOND_MS, TimeRange
from pulseframe.sources.packets import is_finite, is_json_number  # noqa: F401  (part of this module's surface)

# End of the year 9998, the last full year a day key can name in every zone.
_LAST_SECOND = 253370764799
_FIRST_SECOND = -62104060800
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def of_device(df: DataFrame, device_id: str) -> DataFrame:
    """Rows of one device (prunes partitions on a partitioned table)."""
    return df.where(F.col("device_id") == device_id)


def in_range(df: DataFrame, span: TimeRange, column: str = "ts_ms") -> DataFrame:
    """Rows inside a closed time range."""
    return df.where(span.contains(F.col(column)))


def of_params(df: DataFrame, params: Sequence[str] | None, exact: bool = False) -> DataFrame:
    """Rows of the listed parameters; no list means all.

    ``exact`` compares as written; otherwise the list is trimmed and upper-cased.  A list
    of any length stays one predicate, which Spark tests by hash; use a join for names
    that are themselves a table.
    """
    if not params:
        return df
    wanted = sorted({p if exact else p.strip().upper() for p in params})
    return df.where(F.col("param_id").isin(wanted))


def valid_codes(df: DataFrame) -> DataFrame:
    """Rows with a valid parameter code."""
    return df.where(codes.is_param_code(F.col("param_id")))


def finite_values(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows with a finite value."""
    return df.where(is_finite(F.col(column)))


def non_negative_times(df: DataFrame, column: str = "ts_ms") -> DataFrame:
    """Rows with a time at or after the epoch."""
    return df.where(F.col(column) >= 0)


def matched_lists(df: DataFrame) -> DataFrame:
    """Packets whose two lists have the same length."""
    return df.where(F.size("param_ids") == F.size("values"))


def with_points(df: DataFrame) -> DataFrame:
    """Packets with at least one point."""
    return df.where(F.size("points") > 0)


def usable_segments(catalog: DataFrame) -> DataFrame:
    """Segments that hold rows and, where the catalog says so, are sealed."""
    kept = catalog.where(F.col("rows") > 0)
    return kept.where("sealed") if "sealed" in catalog.columns else kept


def _day_hour(ms: int, tz: str) -> tuple[str, str]:
    """Day and hour keys of an instant; those outside the years 2 to 9998 count as their ends."""
    seconds = min(max(ms // SECOND_MS, _FIRST_SECOND), _LAST_SECOND)
    wall = (_EPOCH + timedelta(seconds=seconds)).astimezone(ZoneInfo(tz))
    return wall.date().isoformat(), wall.strftime("%H")


def hour_overlaps(day: Column, hour: Column, span: TimeRange, tz: str = "UTC") -> Column:
    """True for a day/hour key that shares time with the range; bad keys are false.

    Keys sort like the hours they name, so this is a comparison of texts.
    """
    if span.empty or span.to_ms < 0:
        return F.lit(False)
    number = hour.try_cast("int")
    key = F.concat_ws(" ", day, F.lpad(number.cast("string"), 2, "0"))
    first, last = " ".join(_day_hour(span.from_ms, tz)), " ".join(_day_hour(span.to_ms, tz))
    real = F.try_to_date(day, "yyyy-MM-dd").isNotNull() & (F.length(day) == 10) & number.between(0, 23)
    return F.coalesce(key.between(first, last) & real, F.lit(False))


def partition_predicate(span: TimeRange, tz: str = "UTC") -> Column:
    """The ``day``/``hour`` condition implied by a time range.

    ``tz`` is the zone the table was keyed in.  Days may be ``YYYY-MM-DD`` or, as in raw
    archives, ``YYYYMMDD``.  It concerns the partition columns only, so whole directories
    are pruned before any file is opened.
    """
    first, last = "".join(_day_hour(span.from_ms, tz)), "".join(_day_hour(span.to_ms, tz))
    key = F.concat(F.replace(F.col("day").cast("string"), F.lit("-"), F.lit("")), F.lpad(F.col("hour").cast("string"), 2, "0"))
    return key.between(first.replace("-", ""), last.replace("-", ""))


def date_predicate(from_ms: int | None = None, to_ms: int | None = None) -> Column:
    """The ``year``/``month``/``day`` condition (UTC) implied by an open or closed time range."""
    date = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), w, "0") for c, w in (("year", 4), ("month", 2), ("day", 2))])
    bounds = [(from_ms, date.__ge__), (to_ms, date.__le__)]
    return reduce(and_, [test(F.lit(_day_hour(ms, "UTC")[0])) for ms, test in bounds if ms is not None], F.lit(True))


def partitioned_range(table: DataFrame, span: TimeRange, tz: str = "UTC") -> DataFrame:
    """Time range on a table partitioned by day and hour: pruned, then exact."""
    return in_range(table.where(partition_predicate(span, tz)), span)


def on_topics(messages: DataFrame, topic_filter: str) -> DataFrame:
    """Messages whose topic matches a filter with ``+`` and ``#``."""
    return messages.where(topics.topic_matches(F.col("topic"), topic_filter))


def may_contain(param_ids: Column, param_id: str) -> Column:
    """True when a segment may hold a parameter; an empty set means unknown."""
    return (F.size(param_ids) == 0) | F.array_contains(param_ids, param_id)


def points_only(df: DataFrame) -> DataFrame:
    """Projection to the three point columns."""
    return df.select("ts_ms", "param_id", "value")
