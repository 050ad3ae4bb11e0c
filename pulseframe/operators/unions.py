"""Unions of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import HOUR_MS, TimeRange

# Fixed value: length of the recent window.
HOT_WINDOW_MS = HOUR_MS

COLD, HOT = "cold", "hot"


def unified(cold: DataFrame, hot: DataFrame, span: TimeRange, boundary_ms: int) -> DataFrame:
    """Cold rows below the boundary and hot rows from it on, tagged by source.

    The two ranges are disjoint, so no duplicate removal is needed, and each side
    gets a plain time predicate that reaches its scan.
    """
    below, above = span.split(boundary_ms)
    columns = [c for c in cold.columns if c in hot.columns]
    return _tagged(cold, below, COLD, columns).unionByName(_tagged(hot, above, HOT, columns))


def _tagged(df: DataFrame, span: TimeRange, name: str, columns: list[str]) -> DataFrame:
    kept = df.where(F.lit(False)) if span.empty else df.where(span.contains(F.col("ts_ms")))
    return kept.select(*columns).withColumn("source", F.lit(name))


def hot_boundary(now_ms: int) -> int:
    """Start of the recent window."""
    return now_ms - HOT_WINDOW_MS


def all_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both sides, repeats included."""
    return first.unionByName(second)


def distinct_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Set union."""
    return first.unionByName(second).distinct()
