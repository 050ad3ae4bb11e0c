"""RSH: between packets, points and wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import PACKETS, PTS, day_points, joined, packets, points, subscriptions, SUBSCRIPTIONS
from checks.registry import check
from pulseframe.operators import reshape


@check("rsh_01_packets_to_points", f"WITH {PACKETS} SELECT device_id, ts_ms, param_id, value FROM cells")
def packets_to_points(spark, sf_dir):
    return reshape.packets_to_points(packets(spark, sf_dir))


@check(
    "rsh_02_points_to_packets",
    f"""WITH {PACKETS} SELECT device_id, ts_ms, array_to_string(param_ids, ',') AS params,
        array_to_string(list_transform(vals, lambda v: CAST(v AS VARCHAR)), ',') AS texts FROM packets""",
)
def points_to_packets(spark, sf_dir):
    return reshape.points_to_packets(day_points(spark, sf_dir)).select(
        "device_id", "ts_ms", joined(F.col("param_ids")).alias("params"), joined(F.col("values")).alias("texts")
    )


@check(
    "rsh_03_wide_by_params",
    f"""WITH {PTS}
    SELECT ts_ms, coalesce(max(CASE WHEN param_id = 'P00001' THEN value END), 'NaN'::DOUBLE) AS "P00001",
           coalesce(max(CASE WHEN param_id = 'P00003' THEN value END), 'NaN'::DOUBLE) AS "P00003",
           coalesce(max(CASE WHEN param_id = 'P00009' THEN value END), 'NaN'::DOUBLE) AS "P00009"
    FROM pts WHERE param_id IN ('P00001', 'P00003', 'P00009') GROUP BY ts_ms""",
)
def wide_by_params(spark, sf_dir):
    params = ["p00001", "P00003", "P00009"]
    return reshape.wide_by_params(points(spark, sf_dir), params)


DAY_CELLS = """
  max(CASE WHEN param_id = 'A00001' THEN value END) AS "A00001", max(CASE WHEN param_id = 'P00001' THEN value END) AS "P00001",
  max(CASE WHEN param_id = 'P00002' THEN value END) AS "P00002", max(CASE WHEN param_id = 'P00003' THEN value END) AS "P00003",
  max(CASE WHEN param_id = 'Z00001' THEN value END) AS "Z00001"
"""


@check("rsh_04_wide_discovered", f"WITH {PACKETS} SELECT device_id, ts_ms, {DAY_CELLS} FROM cells GROUP BY ALL")
def wide_discovered(spark, sf_dir):
    return reshape.wide_discovered(day_points(spark, sf_dir), ("device_id", "ts_ms"))


@check(
    "rsh_04_wide_text",
    f"""WITH {PACKETS}, wide AS (SELECT device_id, ts_ms, {DAY_CELLS} FROM cells GROUP BY ALL)
    SELECT device_id, ts_ms, coalesce(printf('%.6f', "A00001"), '') AS "A00001", coalesce(printf('%.6f', "P00001"), '') AS "P00001",
           coalesce(printf('%.6f', "P00002"), '') AS "P00002", coalesce(printf('%.6f', "P00003"), '') AS "P00003",
           coalesce(printf('%.6f', "Z00001"), '') AS "Z00001"
    FROM wide""",
)
def wide_text(spark, sf_dir):
    keys = ("device_id", "ts_ms")
    return reshape.wide_text(reshape.wide_discovered(day_points(spark, sf_dir), keys), keys)


@check(
    "rsh_05_sparse_record",
    f"""WITH {PACKETS}
    SELECT device_id, ts_ms AS timestamp, max(CASE WHEN param_id = 'P00001' THEN value END) AS point_0001,
           max(CASE WHEN param_id = 'P00002' THEN value END) AS point_0002, CAST(NULL AS DOUBLE) AS point_0004
    FROM cells GROUP BY ALL""",
)
def sparse_record(spark, sf_dir):
    return reshape.sparse_wide(day_points(spark, sf_dir), [1, 2, 4])


@check(
    "rsh_06_single_point_json",
    f"""WITH {PTS} SELECT device_id, ts_ms, param_id,
        '{{"ts":' || ts_ms || ',"param_ids":["' || param_id || '"],"values":[' || CAST(value AS VARCHAR) || ']}}' AS json
    FROM pts""",
)
def single_point_json(spark, sf_dir):
    return reshape.single_point_json(points(spark, sf_dir))


@check(
    "rsh_07_summed_pivot",
    f"""WITH {PTS}
    SELECT device_id, CAST(sum(CASE WHEN param_id = 'P00001' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS "P00001",
           CAST(sum(CASE WHEN param_id = 'Z00001' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS "Z00001"
    FROM pts GROUP BY device_id""",
)
def summed_pivot(spark, sf_dir):
    exact = points(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    wide = reshape.summed_pivot(exact, ["P00001", "Z00001"], ("device_id",))
    return wide.select("device_id", F.col("P00001").cast("double").alias("P00001"), F.col("Z00001").cast("double").alias("Z00001"))


@check(
    "rsh_08_live_table",
    f"""WITH {PACKETS}, wide AS (SELECT device_id, ts_ms, {DAY_CELLS} FROM cells GROUP BY ALL)
    SELECT device_id, ts_ms, coalesce(CAST("A00001" AS VARCHAR), '-') AS "A00001", coalesce(CAST("P00001" AS VARCHAR), '-') AS "P00001",
           coalesce(CAST("P00002" AS VARCHAR), '-') AS "P00002", coalesce(CAST("P00003" AS VARCHAR), '-') AS "P00003",
           coalesce(CAST("Z00001" AS VARCHAR), '-') AS "Z00001"
    FROM wide""",
)
def live_table(spark, sf_dir):
    headers = reshape.subscribed_headers(subscriptions(spark, sf_dir))
    return reshape.live_table(day_points(spark, sf_dir), headers)


@check("rsh_08_headers", f"WITH {SUBSCRIPTIONS} SELECT DISTINCT unnest(param_ids) AS param_id FROM subs")
def headers(spark, sf_dir):
    return subscriptions(spark, sf_dir).select(F.explode("param_ids").alias("param_id")).distinct()
