"""Between packets, points and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.functions import codes
from pulseframe.functions.text import fixed_decimals
from pulseframe.functions.topics import MISSING_TEXT
from pulseframe.operators.filters import of_params

# Wide tables up to this width are built in one aggregate.
MAX_CONDITIONAL_COLUMNS = 64


def packets_to_points(packets: DataFrame) -> DataFrame:
    """Parallel lists to one row per point; packets with unequal lists are dropped."""
    rows = packets.where(F.size("param_ids") == F.size("values"))
    return rows.select("device_id", "ts_ms", F.inline(F.arrays_zip("param_ids", "values")).alias("param_id", "value"))


def points_to_packets(points: DataFrame, value_type: str = "double") -> DataFrame:
    """Points to one packet per device and time, lists sorted by parameter.

    Repeated points of one parameter are reduced before the lists are built, so
    a list is never longer than the number of parameters.
    """
    unique = points.groupBy("device_id", "ts_ms", "param_id").agg(F.max("value").alias("value"))
    gathered = unique.groupBy("device_id", "ts_ms").agg(
        F.array_sort(F.collect_list(F.struct("param_id", "value"))).alias("points")
    )
    return gathered.select(
        "device_id",
        "ts_ms",
        F.col("points.param_id").alias("param_ids"),
        F.col("points.value").cast(f"array<{value_type}>").alias("values"),
    )


def _wide(points: DataFrame, params: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Largest value per parameter column; NULL where absent.

    Few columns: one hash aggregate with a conditional maximum per column, so one
    shuffle.  Many columns: ``pivot``, which costs a second shuffle but no longer
    tests every row against every column.
    """
    if not params:
        return points.select(*keys).distinct()
    if len(params) > MAX_CONDITIONAL_COLUMNS:
        return points.groupBy(*keys).pivot("param_id", list(params)).agg(F.max("value"))
    cells = [F.max(F.when(F.col("param_id") == p, F.col("value"))).alias(p) for p in params]
    return points.groupBy(*keys).agg(*cells)


def wide_by_params(points: DataFrame, params: Sequence[str], keys: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """One column per requested parameter, NaN where absent, one row per time.

    Requested names are trimmed and upper-cased, as stored names are.
    """
    wanted = list(dict.fromkeys(p.strip().upper() for p in params))
    rows = _wide(of_params(points, wanted), wanted, keys)
    return rows.select(*keys, *[F.coalesce(F.col(p), F.lit(float("nan"))).alias(p) for p in wanted])


def discovered_params(points: DataFrame, limit: int = schema.MAX_POINT_COLUMNS) -> list[str]:
    """Sorted parameters present; more than ``limit`` is an error.

    Only distinct names reach the driver, and never more than ``limit + 1``.
    """
    names = [r[0] for r in points.select("param_id").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} parameters; name the wanted ones")
    return sorted(names)


def wide_discovered(points: DataFrame, keys: Sequence[str] = ("ts_ms",), limit: int = schema.MAX_POINT_COLUMNS) -> DataFrame:
    """One column per parameter present, in name order, NULL where absent."""
    return _wide(points, discovered_params(points, limit), keys)


def wide_text(wide: DataFrame, keys: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Cells of a wide table as text with six decimals, empty where absent."""
    cells = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.coalesce(fixed_decimals(F.col(c), 6), F.lit("")).alias(c) for c in cells])


def sparse_wide(points: DataFrame, point_numbers: Sequence[int]) -> DataFrame:
    """Numeric point codes to ``point_NNNN`` columns; other codes are dropped.

    Every packet keeps its row, also when none of its codes has a column.
    """
    outside = [n for n in point_numbers if not 1 <= n <= schema.MAX_POINT_COLUMNS]
    if outside:
        raise ValueError(f"point numbers outside 1…{schema.MAX_POINT_COLUMNS}: {outside}")
    numbered = points.withColumn("point", codes.point_index(F.col("param_id")))
    cells = [F.max(F.when(F.col("point") == n, F.col("value"))).alias(f"point_{n:04d}") for n in point_numbers]
    return numbered.groupBy("device_id", F.col("ts_ms").alias("timestamp")).agg(*cells)


def single_point_json(points: DataFrame) -> DataFrame:
    """Each point as a JSON row with one-element lists."""
    row = F.struct(
        F.col("ts_ms").alias("ts"),
        F.array("param_id").alias("param_ids"),
        F.array("value").alias("values"),
    )
    return points.select("device_id", "ts_ms", "param_id", F.to_json(row).alias("json"))


def summed_pivot(points: DataFrame, params: Sequence[str], keys: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Sum per parameter and time, one column per listed parameter."""
    return points.groupBy(*keys).pivot("param_id", list(params)).agg(F.sum("value"))


def subscribed_headers(subscriptions: DataFrame, limit: int = schema.MAX_POINT_COLUMNS) -> list[str]:
    """All subscribed parameters, sorted: the columns of the live table."""
    return discovered_params(subscriptions.select(F.explode("param_ids").alias("param_id")), limit)


def live_table(points: DataFrame, headers: Sequence[str], keys: Sequence[str] = ("device_id", "ts_ms")) -> DataFrame:
    """Value texts under the given headers, a dash where absent."""
    rows = _wide(points, headers, keys)
    return rows.select(*keys, *[F.coalesce(F.col(h).cast("string"), F.lit(MISSING_TEXT)).alias(h) for h in headers])
