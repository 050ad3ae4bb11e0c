"""Time-range joins by equality on blocks of hours, in two cases that exclude each other.

A segment shares time with an interval in one of two ways:

* it starts inside the interval.  The segment is a point, its first hour, told at two widths
  (an hour, and ``1 << _COARSE`` hours); the interval lists the hours at its ends and the wide
  blocks between them.
* it holds the interval's start, and starts before it.  The interval is a point, told at
  every width; the segment names the one or two blocks of the width that fits its own length.

So a segment becomes four rows at most however long it is, both inputs are read once, one
equi-join finds the pairs, and none is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import HOUR_MS, floor_div

# Hours up to 2^24 reach to the year 3883; later ones share the last block.
_LAST_HOUR = (1 << 24) - 1
_COARSE = 7
#: Widths of the second case: blocks of 8^level hours.
_BITS, _TOP_LEVEL = 3, 8

_STARTS, _HOLDS = 0, 1


def _hour(ms: Column) -> Column:
    return F.least(F.greatest(floor_div(ms, HOUR_MS), F.lit(0)), F.lit(_LAST_HOUR)).cast("bigint")


def _up(hour: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", hour, F.lit(bits) if isinstance(bits, int) else bits)


def _block(case: int, bits: Column | int, at: Column) -> Column:
    """Case, width and place as one number, which is smaller to shuffle and sort than a struct."""
    width = F.lit(bits) if isinstance(bits, int) else bits
    return at.cast("bigint") * 64 + width.cast("bigint") * 2 + case


def _series(first: Column, last: Column) -> Column:
    """Whole numbers from first to last; none when reversed."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _of_segment(first: Column, last: Column) -> Column:
    fitting = [F.when(_up(last, _BITS * k) - _up(first, _BITS * k) <= 1, F.lit(_BITS * k)) for k in range(_TOP_LEVEL + 1)]
    bits = F.coalesce(*fitting, F.lit(_BITS * _TOP_LEVEL))
    starts = F.array(_block(_STARTS, 0, first), _block(_STARTS, _COARSE, _up(first, _COARSE)))
    holds = F.array_distinct(F.array(_block(_HOLDS, bits, _up(first, bits)), _block(_HOLDS, bits, _up(last, bits))))
    return F.concat(starts, holds)


def _of_interval(first: Column, last: Column) -> Column:
    size = 1 << _COARSE
    # Wide blocks that lie inside; where there is none, all hours are told one by one.
    low, high = _up(first + (size - 1), _COARSE), _up(last + 1, _COARSE) - 1
    inside = low <= high
    before = _series(first, F.when(inside, low * size - 1).otherwise(last))
    after = F.when(inside, _series((high + 1) * size, last)).otherwise(F.array().cast("array<bigint>"))
    hours = F.transform(F.concat(before, after), lambda h: _block(_STARTS, 0, h))
    wide = F.transform(_series(low, high), lambda b: _block(_STARTS, _COARSE, b))
    holds = F.array(*[_block(_HOLDS, _BITS * k, _up(first, _BITS * k)) for k in range(_TOP_LEVEL + 1)])
    return F.concat(hours, wide, holds)


def overlap_join(intervals: DataFrame, segments: DataFrame, param: str | None = None) -> DataFrame:
    """Query intervals with the segments that share time with them, per device.

    ``intervals``: ``device_id, from_ms, to_ms, …``; ``segments``: ``device_id, min_ts,
    max_ts, …``.  ``param`` names an interval column that the segment's parameter set must
    contain (an empty set may contain anything).
    """
    wanted = intervals.where(F.col("from_ms") <= F.col("to_ms"))
    usable = segments.where(F.col("min_ts") <= F.col("max_ts"))
    asked = wanted.withColumn("_block", F.explode(_of_interval(_hour(F.col("from_ms")), _hour(F.col("to_ms")))))
    stored = usable.withColumn("_block", F.explode(_of_segment(_hour(F.col("min_ts")), _hour(F.col("max_ts")))))
    from_ms = F.col("from_ms")
    starts = F.col("min_ts").between(from_ms, F.col("to_ms"))
    holds = (F.col("min_ts") < from_ms) & (F.col("max_ts") >= from_ms)
    meets = F.when(F.col("_block").bitwiseAND(1) == _STARTS, starts).otherwise(holds)
    # Sizes are estimated from the files below and know nothing of the blocks listed here: a
    # broadcast chosen by them holds many times as much in the driver.
    pairs = asked.join(stored.hint("merge"), ["device_id", "_block"]).where(meets).drop("_block")
    if param is not None:
        pairs = pairs.where((F.size("param_ids") == 0) | F.array_contains("param_ids", F.col(param)))
    return pairs
