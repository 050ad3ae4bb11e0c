"""SET: unions of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import BOUNDARY_MS, CATALOG, PTS, SUBSCRIPTIONS, catalog, points, subscriptions
from checks.registry import check
from pulseframe.functions.timeparts import TimeRange
from pulseframe.operators import unions

COLUMNS = ["device_id", "ts_ms", "param_id", "value"]
SPAN = TimeRange(1704300000000, 1705300000000)


@check(
    "set_01_unified",
    f"""WITH {PTS} SELECT device_id, ts_ms, param_id, value, CASE WHEN ts_ms < {BOUNDARY_MS} THEN 'cold' ELSE 'hot' END AS source
    FROM pts WHERE ts_ms BETWEEN {SPAN.from_ms} AND {SPAN.to_ms}""",
)
def unified(spark, sf_dir):
    # Both sides hold everything, so an overlap would show as repeats.
    rows = points(spark, sf_dir).select(COLUMNS)
    return unions.unified(rows, rows, SPAN, BOUNDARY_MS)


@check(
    "set_01_unified_cold_only",
    f"WITH {PTS} SELECT ts_ms, param_id, value, 'cold' AS source FROM pts WHERE ts_ms BETWEEN {SPAN.from_ms} AND {BOUNDARY_MS - 1}",
)
def unified_cold_only(spark, sf_dir):
    rows = points(spark, sf_dir).select("ts_ms", "param_id", "value")
    return unions.unified(rows, rows, TimeRange(SPAN.from_ms, BOUNDARY_MS - 1), BOUNDARY_MS)


@check(
    "set_02_all_rows",
    f"""WITH {PTS} SELECT event_id, value FROM pts WHERE param_id = 'P00001'
    UNION ALL SELECT event_id, value FROM pts WHERE param_id IN ('P00001', 'P00002')""",
)
def all_rows(spark, sf_dir):
    first = points(spark, sf_dir).where("param_id = 'P00001'").select("event_id", "value")
    second = points(spark, sf_dir).where("param_id IN ('P00001', 'P00002')").select("event_id", "value")
    return unions.all_rows(first, second).orderBy("event_id")


@check("set_03_active_and_flushing", f"WITH {PTS} SELECT device_id, ts_ms, param_id, value FROM pts")
def active_and_flushing(spark, sf_dir):
    rows = points(spark, sf_dir).select(COLUMNS)
    flushing = F.col("ts_ms") < BOUNDARY_MS
    return unions.all_rows(rows.where(~flushing), rows.where(flushing))


@check(
    "set_04_candidate_files",
    f"WITH {CATALOG} SELECT segment_file FROM catalog WHERE hour IN ('04', '05') OR rows > 1",
)
def candidate_files(spark, sf_dir):
    known = catalog(spark, sf_dir)
    by_hour = known.where(F.col("hour").isin("04", "05")).select("segment_file")
    return unions.distinct_rows(by_hour, known.where(F.col("rows") > 1).select("segment_file"))


@check(
    "set_05_distinct_names",
    f"""WITH {PTS}, {SUBSCRIPTIONS}
    SELECT device_id AS name FROM pts UNION SELECT unnest(param_ids) FROM subs""",
)
def distinct_names(spark, sf_dir):
    devices = points(spark, sf_dir).select(F.col("device_id").alias("name"))
    params = subscriptions(spark, sf_dir).select(F.explode("param_ids").alias("name"))
    return unions.distinct_rows(devices, params)
