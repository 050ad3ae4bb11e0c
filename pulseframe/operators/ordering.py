"""Order, limits and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import MINUTE_MS, floor_div
from pulseframe.operators.latest import top_per_key
from pulseframe.operators.sequence import total_order

# Default limits and page bounds.
QUERY_LIMIT = 100
EXPORT_LIMIT = 1_000
RAW_LIMIT = 200
PAGE_LIMIT, PAGE_MIN, PAGE_MAX = 200, 1, 5_000

# Results of scans up to this size are put in order by one task.  Files are counted as they are
# stored, and a sort holds ten times that and more: 48 MB of events took 575 MB of one task.
ONE_TASK_BYTES = 4 << 20


def expected_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate; of a scan, the files left after partition pruning."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def by_time(points: DataFrame, one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """Points in total order: time, then parameter.

    A global sort reads its input twice, first to find the ranges.  A result that is
    small for certain goes to one task instead; the order is the same.
    """
    if expected_bytes(points) <= one_task_bytes:
        return points.repartition(1).sortWithinPartitions("ts_ms", "param_id")
    return points.orderBy("ts_ms", "param_id")


def by_param_within_files(points: DataFrame) -> DataFrame:
    """Parameter, then time, inside each output partition."""
    return points.sortWithinPartitions("param_id", "ts_ms")


def first_rows(df: DataFrame, n: int = QUERY_LIMIT, order: Sequence[str] = ("ts_ms", "param_id")) -> DataFrame:
    """First ``n`` rows in order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def page(
    df: DataFrame,
    offset: int = 0,
    limit: int | None = None,
    order: Sequence[str] = ("ts_ms", "param_id"),
    largest: int = PAGE_MAX,
    width: int = MINUTE_MS,
) -> DataFrame:
    """One page in order; the limit is clamped to 1…``largest``.

    ``order`` starts with a whole number, as a time; the other columns break ties.
    Rows are counted per block of ``width`` of it.  The counts, one row per block,
    tell which blocks hold the page and how many rows lie before them; only the rows
    of those blocks are put in order, whatever the offset.
    """
    if offset < 0:
        raise ValueError("offset must not be negative")
    size = min(max(PAGE_LIMIT if limit is None else limit, PAGE_MIN), largest)
    order = total_order(df, order)
    # NULL sorts first.
    block = F.coalesce(floor_div(F.col(order[0]), width), F.lit(-(1 << 63)))
    counts = df.groupBy(block.alias("_block")).agg(F.count("*").alias("_rows"))
    counted = counts.withColumn("_upto", F.sum("_rows").over(Window.orderBy("_block")))
    held = counted.where((F.col("_upto") > offset) & (F.col("_upto") - F.col("_rows") < offset + size))
    bounds = F.struct(F.min("_block").alias("a"), F.max("_block").alias("b"), F.min(F.col("_upto") - F.col("_rows")).alias("n"))
    bounds = held.agg(bounds.alias("bounds")).scalar()
    position = F.row_number().over(Window.orderBy(*order)) + bounds["n"]
    near = df.where(block.between(bounds["a"], bounds["b"])).withColumn("_position", position)
    held = near.where(F.col("_position").between(offset + 1, offset + size)).drop("_position")
    return held.orderBy(*order).limit(size)


def total_rows(df: DataFrame) -> DataFrame:
    """Number of matches before paging."""
    return df.agg(F.count("*").alias("total"))


def segments_in_order(catalog: DataFrame) -> DataFrame:
    """Segments by day, hour and part."""
    return catalog.orderBy("day", "hour", "part")


def subscriptions_in_order(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions by client and device."""
    return subscriptions.orderBy("client_id", "device_id")


def first_per_device(points: DataFrame, n: int, flushing_rank: str = "flushing") -> DataFrame:
    """First ``n`` points per device: active before flushing, then time and parameter."""
    return top_per_key(points, ["device_id"], [F.col(flushing_rank), F.col("ts_ms"), F.col("param_id")], n)
