"""SRT: order, limits and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import BOUNDARY_MS, CATALOG, PTS, SUBSCRIPTIONS, catalog, points, subscriptions
from checks.registry import check
from pulseframe.operators import ordering
from pulseframe.operators.filters import of_params
from pulseframe.operators.sequence import numbered

ORDER = ("ts_ms", "param_id", "event_id")
COLUMNS = ["event_id", "ts_ms", "param_id", "value"]


@check("srt_01_by_time", f"WITH {PTS} SELECT event_id, ts_ms, param_id, value FROM pts ORDER BY ts_ms, param_id")
def by_time(spark, sf_dir):
    return ordering.by_time(points(spark, sf_dir).select(COLUMNS))


@check("srt_02_within_files", f"WITH {PTS} SELECT event_id, ts_ms, param_id, value FROM pts")
def within_files(spark, sf_dir):
    return ordering.by_param_within_files(points(spark, sf_dir).select(COLUMNS))


@check("srt_03_first_rows", f"WITH {PTS} SELECT event_id, ts_ms, param_id, value FROM pts ORDER BY ts_ms, param_id, event_id LIMIT 100")
def first_rows(spark, sf_dir):
    return ordering.first_rows(points(spark, sf_dir).select(COLUMNS), order=ORDER)


@check(
    "srt_04_page",
    f"WITH {PTS} SELECT event_id, ts_ms, param_id, value FROM pts ORDER BY ts_ms, param_id, event_id LIMIT 200 OFFSET 1000",
)
def page(spark, sf_dir):
    return ordering.page(points(spark, sf_dir).select(COLUMNS), 1000, order=ORDER)


@check(
    "srt_04_page_clamped",
    f"WITH {PTS} SELECT event_id, ts_ms, param_id, value FROM pts ORDER BY ts_ms, param_id, event_id LIMIT 5000 OFFSET 100",
)
def page_clamped(spark, sf_dir):
    return ordering.page(points(spark, sf_dir).select(COLUMNS), 100, 1_000_000, order=ORDER)


@check("srt_04_total", f"WITH {PTS} SELECT count(*) AS total FROM pts WHERE param_id = 'P00001'")
def total(spark, sf_dir):
    return ordering.total_rows(of_params(points(spark, sf_dir), ["P00001"]))


# The numbering that deep pages are cut from.
@check("srt_04_positions", f"WITH {PTS} SELECT event_id, row_number() OVER (ORDER BY ts_ms, param_id, event_id) AS position FROM pts")
def positions(spark, sf_dir):
    rows = points(spark, sf_dir).select(COLUMNS)
    return numbered(rows, [], list(ORDER), "position").select("event_id", "position")


@check(
    "srt_05_segments_in_order",
    f"WITH {CATALOG} SELECT day, CAST(hour AS INTEGER) AS hour, CAST(substr(device_id, 4) AS INTEGER) AS part FROM catalog",
)
def segments_in_order(spark, sf_dir):
    parts = catalog(spark, sf_dir).select(
        "day", F.col("hour").cast("int").alias("hour"), F.substring("device_id", 4, 6).cast("int").alias("part")
    )
    return ordering.segments_in_order(parts)


@check("srt_06_subscriptions_in_order", f"WITH {SUBSCRIPTIONS} SELECT client_id, device_id FROM subs ORDER BY 1, 2")
def subscriptions_in_order(spark, sf_dir):
    return ordering.subscriptions_in_order(subscriptions(spark, sf_dir).select("client_id", "device_id"))


@check(
    "srt_07_first_per_device",
    f"""WITH {PTS} SELECT device_id, event_id FROM pts
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts_ms < {BOUNDARY_MS}, ts_ms, param_id) <= 7""",
)
def first_per_device(spark, sf_dir):
    hot = points(spark, sf_dir).withColumn("flushing", F.col("ts_ms") < BOUNDARY_MS)
    return ordering.first_per_device(hot, 7).select("device_id", "event_id")
