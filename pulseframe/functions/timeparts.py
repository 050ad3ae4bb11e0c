"""Epoch milliseconds to calendar parts and back.

``ts_ms`` is always epoch milliseconds.  Calendar parts need an explicit zone
(default UTC); all of them go through TIMESTAMP_NTZ, so the session time zone
never changes a result.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.columns import evaluated_once

SECOND_MS = 1_000
MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# Units of a duration text.
DURATION_UNITS_MS = {"s": SECOND_MS, "m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS}


def floor_div(value: Column, divisor: int) -> Column:
    """Integer quotient rounded down."""
    return F.call_function("div", value - F.pmod(value, F.lit(divisor)), F.lit(divisor))


def floor_seconds(ts_ms: Column) -> Column:
    """Whole epoch seconds."""
    return floor_div(ts_ms, SECOND_MS)


def event_time(ts_ms: Column) -> Column:
    """TIMESTAMP used for watermarks and windows."""
    return F.timestamp_millis(ts_ms)


def local_time(ts_ms: Column, tz: str = "UTC") -> Column:
    """Wall-clock TIMESTAMP_NTZ of an instant in a zone."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    utc = F.timestamp_add("MILLISECOND", ts_ms, epoch)
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def ntz_millis(wall: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ read as UTC."""
    seconds = F.hour(wall) * 3600 + F.minute(wall) * 60
    millis = (F.extract(F.lit("SECOND"), wall) * F.lit(SECOND_MS)).cast("bigint")
    return F.unix_date(wall.cast("date")).cast("bigint") * F.lit(DAY_MS) + seconds.cast("bigint") * F.lit(SECOND_MS) + millis


def wall_millis(date: Column, hour: Column, tz: str = "UTC") -> Column:
    """Epoch milliseconds of an hour on a date in a zone."""
    as_utc = F.unix_date(date).cast("bigint") * F.lit(DAY_MS) + hour.cast("bigint") * F.lit(HOUR_MS)
    if tz == "UTC":
        return as_utc
    shifted = F.convert_timezone(F.lit(tz), F.lit("UTC"), local_time(as_utc))
    return evaluated_once(shifted, ntz_millis)


def _local_date(ts_ms: Column, tz: str) -> Column:
    if tz == "UTC":
        return F.date_from_unix_date(floor_div(ts_ms, DAY_MS).cast("int"))
    return local_time(ts_ms, tz).cast("date")


def day_key(ts_ms: Column, tz: str = "UTC", compact: bool = False) -> Column:
    """``YYYY-MM-DD`` (or ``YYYYMMDD``) of an instant."""
    text = _local_date(ts_ms, tz).cast("string")
    return F.replace(text, F.lit("-"), F.lit("")) if compact else text


def hour_of_day(ts_ms: Column, tz: str = "UTC") -> Column:
    """Hour 0–23 of an instant."""
    if tz == "UTC":
        return floor_div(F.pmod(ts_ms, F.lit(DAY_MS)), HOUR_MS).cast("int")
    return F.hour(local_time(ts_ms, tz))


def hour_text(ts_ms: Column, tz: str = "UTC") -> Column:
    """Two-digit hour of an instant."""
    return F.lpad(hour_of_day(ts_ms, tz).cast("string"), 2, "0")


def hour_start(ts_ms: Column, tz: str = "UTC") -> Column:
    """First millisecond of the hour an instant lies in."""
    if tz == "UTC":
        return ts_ms - F.pmod(ts_ms, F.lit(HOUR_MS))
    wall = local_time(ts_ms, tz)
    past = F.minute(wall) * MINUTE_MS + (F.extract(F.lit("SECOND"), wall) * F.lit(SECOND_MS)).cast("bigint")
    return ts_ms - past


def next_hour(ts_ms: Column, tz: str = "UTC") -> Column:
    """First millisecond of the following hour (calendar-correct)."""
    return hour_start(ts_ms, tz) + F.lit(HOUR_MS)


def _parsed_day(key: Column) -> Column:
    compact = F.when(key.rlike(r"^[0-9]{8}\z"), F.try_to_date(key, "yyyyMMdd"))
    dashed = F.when(key.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(key, "yyyy-MM-dd"))
    return F.coalesce(compact, dashed)


def day_start_ms(key: Column, tz: str = "UTC") -> Column:
    """First millisecond of a day key; NULL for a bad key."""
    return wall_millis(_parsed_day(key), F.lit(0), tz)


def day_end_ms(key: Column, tz: str = "UTC") -> Column:
    """Last millisecond of a day key: next midnight minus one."""
    return wall_millis(F.date_add(_parsed_day(key), 1), F.lit(0), tz) - F.lit(1)


def hour_start_from_text(text: Column, tz: str = "UTC") -> Column:
    """``YYYYMMDDHH`` in a zone to epoch milliseconds; NULL when malformed."""
    hour = F.substring(text, 9, 2).try_cast("int")
    start = wall_millis(F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"), hour, tz)
    return F.when(text.rlike(r"^[0-9]{8}([01][0-9]|2[0-3])\z"), start)


def duration_millis(text: Column) -> Column:
    """``30m``, ``6h``, ``2d`` to milliseconds; NULL when malformed."""
    number = F.nullif(F.regexp_extract(text, r"^([0-9]+)[smhdSMHD]\z", 1), F.lit("")).try_cast("bigint")
    unit = F.lower(F.right(text, F.lit(1)))
    scale = F.coalesce(*[F.when(unit == name, F.lit(ms)) for name, ms in DURATION_UNITS_MS.items()])
    return F.try_multiply(number, scale.cast("bigint"))


def hour_series(from_ms: Column, to_ms: Column) -> Column:
    """Array of hour starts that cover a closed interval; empty when reversed."""
    first = from_ms - F.pmod(from_ms, F.lit(HOUR_MS))
    hours = F.sequence(first, F.greatest(to_ms, first), F.lit(HOUR_MS).cast("bigint"))
    return F.when(from_ms <= to_ms, hours).otherwise(F.array().cast("array<bigint>"))


def intervals_overlap(min_ms: Column, max_ms: Column, from_ms: Column, to_ms: Column) -> Column:
    """True when two closed intervals share a point."""
    return (max_ms >= from_ms) & (min_ms <= to_ms)


def duration_ms(text: str) -> int:
    """Driver-side form of :func:`duration_millis`; malformed text is an error."""
    match = re.fullmatch(r"([0-9]+)([smhdSMHD])", text)
    if match is None:
        raise ValueError(f"invalid duration: {text!r} (expected <num>[s|m|h|d])")
    return int(match[1]) * DURATION_UNITS_MS[match[2].lower()]


def day_bounds(key: str, tz: str = "UTC") -> tuple[int, int]:
    """First and last millisecond of a day in a zone."""
    for pattern, form in ((r"\d{8}", "%Y%m%d"), (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d")):
        if re.fullmatch(pattern, key, re.ASCII):
            day = datetime.strptime(key, form).date()
            break
    else:
        raise ValueError(f"invalid day: {key!r}")
    start, end = _midnight_ms(day, tz), _midnight_ms(day + timedelta(days=1), tz) - 1
    if start < 0:
        raise ValueError("negative timestamps are not supported")
    return start, end


def _midnight_ms(day: date, tz: str) -> int:
    return round(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz)).timestamp() * SECOND_MS)


@dataclass(frozen=True)
class TimeRange:
    """Closed interval of epoch milliseconds."""

    from_ms: int
    to_ms: int

    def contains(self, ts_ms: Column) -> Column:
        """Predicate that reaches the Parquet scan."""
        return ts_ms.between(self.from_ms, self.to_ms)

    def split(self, boundary_ms: int) -> tuple[TimeRange, TimeRange]:
        """The parts below and from a boundary; a part may be empty."""
        return (
            TimeRange(self.from_ms, min(self.to_ms, boundary_ms - 1)),
            TimeRange(max(self.from_ms, boundary_ms), self.to_ms),
        )

    @property
    def empty(self) -> bool:
        return self.from_ms > self.to_ms


def resolve_range(
    from_ms: int | None = None,
    to_ms: int | None = None,
    day: str | None = None,
    today: bool = False,
    last: str | None = None,
    everything: bool = False,
    now_ms: int | None = None,
    tz: str = "UTC",
) -> TimeRange:
    """One of five ways to name a range; the first given one wins."""
    now = int(time.time() * SECOND_MS) if now_ms is None else now_ms
    if from_ms is not None and to_ms is not None:
        if from_ms > to_ms:
            raise ValueError("from must not be after to")
        return TimeRange(from_ms, to_ms)
    if day is not None:
        return TimeRange(*day_bounds(day, tz))
    if today:
        return TimeRange(*day_bounds(datetime.fromtimestamp(now / SECOND_MS, ZoneInfo(tz)).strftime("%Y%m%d"), tz))
    if last is not None:
        return TimeRange(max(now - duration_ms(last), 0), now)
    if everything:
        return TimeRange(0, now)
    raise ValueError("name a time range: from and to, day, today, last or everything")
